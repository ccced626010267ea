"""Currency conversion, pay-period detection and monthly normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.numbers import half_up, round_cents


def default_rates(spark: SparkSession) -> DataFrame:
    """Built-in rate table (currency, rate_to_pln) used where no feed is given."""
    return spark.createDataFrame(
        list(fv.FALLBACK_RATES.items()), "currency string, rate_to_pln double"
    )


def rates_from_base_quotes(quotes: DataFrame) -> DataFrame:
    """(currency, rate) quoted per one PLN -> (currency, rate_to_pln); PLN itself is 1."""
    inverted = quotes.where(F.col("rate") > 0).select(
        "currency", (F.lit(1.0) / F.col("rate")).alias("rate_to_pln")
    )
    base = quotes.sparkSession.createDataFrame([(fv.BASE_CURRENCY, 1.0)], inverted.schema)
    return inverted.where(F.col("currency") != fv.BASE_CURRENCY).unionByName(base)


def currency_code(currency: Column) -> Column:
    return F.trim(F.upper(currency))


def to_base_currency(amount: Column, currency: Column, rate: Column) -> Column:
    """Amount in PLN; NULL for an unknown or blank currency."""
    return (
        F.when(amount.isNull() | F.coalesce(currency, F.lit("")).eqNullSafe(""), F.lit(None))
        .when(currency_code(currency) == fv.BASE_CURRENCY, amount)
        .otherwise(round_cents(amount * rate))
        .cast("double")
    )


def to_monthly(amount: Column, period: Column) -> Column:
    p = F.lower(period)
    return (
        F.when(p == "hourly", round_cents(amount * fv.HOURS_PER_MONTH))
        .when(p == "daily", round_cents(amount * fv.DAYS_PER_MONTH))
        .otherwise(amount)
    )


def _mentions(text: Column, marks: list[str]) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | text.contains(mark)
    return F.coalesce(hit, F.lit(False))


def detect_period(
    salary_type: Column,
    salary_max: Column,
    currency: Column,
    explicit_period: Column | None = None,
    url: Column | None = None,
) -> Column:
    """First rule that applies: explicit word, marks in the type text or, beside one, in the URL, size of the amount."""
    chain = None
    if explicit_period is not None:
        word = F.lower(explicit_period)
        for period, synonyms in fv.EXPLICIT_PERIODS.items():
            test = word.isin(synonyms)
            chain = F.when(test, period) if chain is None else chain.when(test, period)
    text = F.lower(salary_type)
    hourly = _mentions(text, fv.HOURLY_MARKS)
    chain = F.when(hourly, "hourly") if chain is None else chain.when(hourly, "hourly")
    chain = chain.when(_mentions(text, fv.DAILY_MARKS), "daily")
    if url is not None:
        chain = chain.when((text != "") & F.lower(url).contains(fv.HOURLY_URL_MARK), "hourly")
    code = F.upper(currency)
    for name, limit in fv.HOURLY_LIMITS.items():
        chain = chain.when(
            (code == name) & (salary_max > 0) & (salary_max < limit), "hourly"
        )
    return chain.otherwise("monthly")


def normalize_salary(
    postings: DataFrame, rates: DataFrame | None = None, explicit_period: str | None = None
) -> DataFrame:
    """Set salary_period, salary_min_pln and salary_max_pln.

    The rate table holds one row per currency code (a few hundred exist), so it is the
    broadcast side of a map-side join.
    """
    rates = rates if rates is not None else default_rates(postings.sparkSession)
    lookup = F.broadcast(
        rates.groupBy(F.col("currency").alias("_code")).agg(F.max("rate_to_pln").alias("_rate"))
    )
    present = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    period = detect_period(
        F.col("salary_type"), F.col("salary_max"), F.col("salary_currency"),
        F.col(explicit_period) if explicit_period else None,
        F.col("url") if "url" in postings.columns else None,
    )
    joined = postings.withColumn("_cur", currency_code(F.col("salary_currency"))).join(
        lookup, F.col("_cur") == F.col("_code"), "left"
    )
    with_period = joined.withColumn("salary_period", F.when(present, period))
    return with_period.withColumns({
        f"salary_{side}_pln": to_monthly(
            to_base_currency(F.col(f"salary_{side}"), F.col("salary_currency"), F.col("_rate")),
            F.col("salary_period"),
        )
        for side in ("min", "max")
    }).drop("_cur", "_code", "_rate")


def hourly_estimate(monthly_pln: Column) -> Column:
    return half_up(monthly_pln / fv.HOURS_PER_MONTH).cast("bigint")


def range_span(low: Column, high: Column) -> Column:
    """Width of a salary bar: a missing low is 0, a missing high equals the low."""
    base = F.coalesce(low, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.coalesce(high, base) - base)
