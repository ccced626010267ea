"""Dashboard aggregates over the filtered postings, per row or per duplicate key.

``grouped=True`` counts distinct (company, lower(title)) keys.  Distinct counts are taken
by making (bucket, key) pairs distinct first, which combines map-side and never sends a
hot key's rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fv
from jobweave.functions.text import present
from jobweave.operators.dedup import KEY, newest_per_key, with_key
from jobweave.operators.filters import contains_ci, facet_present

DIMENSIONS = ["status", "source", "category", "seniority", "work_type", "company"]


def _counted(base: DataFrame, column: str, grouped: bool) -> DataFrame:
    if grouped:
        base = with_key(base).select(column, *[k for k in KEY if k != column]).distinct()
    return base.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def _count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def total_jobs(base: DataFrame, grouped: bool = False) -> DataFrame:
    return _count_rows(with_key(base).select(*KEY).distinct() if grouped else base, "total_jobs")


def by_status(base: DataFrame, grouped: bool = False) -> DataFrame:
    """Grouped: each key counts once, under its alphabetically last status."""
    if grouped:
        base = with_key(base).groupBy(*KEY).agg(F.max("status").alias("status"))
    return base.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def saved_count(base: DataFrame, grouped: bool = False) -> DataFrame:
    saved = base.where("saved")
    return _count_rows(with_key(saved).select(*KEY).distinct() if grouped else saved, "saved_count")


def reposted_count(base: DataFrame, grouped: bool = False) -> DataFrame:
    reposted = base.where("is_reposted")
    return _count_rows(with_key(reposted).select(*KEY).distinct() if grouped else reposted, "reposted_count")


def by_source(base: DataFrame, grouped: bool = False) -> DataFrame:
    return _counted(base, "source", grouped)


def _by_facet(base: DataFrame, column: str, grouped: bool, limit: int | None) -> DataFrame:
    counted = _counted(base.where(facet_present(column)), column, grouped).orderBy(F.desc("count"), F.asc(column))
    return counted if limit is None else counted.limit(limit)


def by_category(base: DataFrame, grouped: bool = False, limit: int = 20) -> DataFrame:
    return _by_facet(base, "category", grouped, limit)


def by_seniority(base: DataFrame, grouped: bool = False) -> DataFrame:
    return _by_facet(base, "seniority", grouped, None)


def by_work_type(base: DataFrame, grouped: bool = False) -> DataFrame:
    return _by_facet(base, "work_type", grouped, None)


def top_companies(base: DataFrame, grouped: bool = False, limit: int = 15) -> DataFrame:
    return _counted(base, "company", grouped).orderBy(F.desc("count"), F.asc("company")).limit(limit)


def _salary_per_key(base: DataFrame) -> DataFrame:
    return (
        with_key(base).where("salary_min_pln IS NOT NULL").groupBy(*KEY)
        .agg(F.avg("salary_min_pln").alias("am"), F.avg("salary_max_pln").alias("ax"), F.max("category").alias("category"))
    )


def salary_stats(base: DataFrame, grouped: bool = False) -> DataFrame:
    """Overall averages, rounded half-even to whole; an average of 0 is reported as NULL.

    Grouped: mean of the per-key means, over rows that have a minimum.
    """
    if grouped:
        means = _salary_per_key(base).agg(F.avg("am").alias("lo"), F.avg("ax").alias("hi"))
    else:
        means = base.agg(F.avg("salary_min_pln").alias("lo"), F.avg("salary_max_pln").alias("hi"))
    shown = lambda c: F.rint(F.nullif(F.col(c), F.lit(0.0)))
    return means.select(shown("lo").alias("avg_min_pln"), shown("hi").alias("avg_max_pln"))


def salary_by_category(base: DataFrame, grouped: bool = False, limit: int = 15) -> DataFrame:
    """Average range per category; categories without any maximum come first."""
    if grouped:
        rows = _salary_per_key(base)
    else:
        rows = base.where("salary_min_pln IS NOT NULL").select(
            "category", F.col("salary_min_pln").alias("am"), F.col("salary_max_pln").alias("ax")
        )
    return (
        rows.where(facet_present("category")).groupBy("category")
        .agg(F.avg("am").alias("am"), F.avg("ax").alias("ax"))
        .orderBy(F.desc_nulls_first("ax"), F.asc("category")).limit(limit)
        .select("category", F.round("am", 0).alias("avg_min"), F.round("ax", 0).alias("avg_max"))
    )


def added_over_time(base: DataFrame, grouped: bool = False) -> DataFrame:
    """Postings per date; grouped: keys per first date."""
    dated = base.where("date_added IS NOT NULL")
    if grouped:
        dated = with_key(dated).groupBy(*KEY).agg(F.min("date_added").alias("date_added"))
    return dated.groupBy(F.col("date_added").alias("date")).agg(F.count(F.lit(1)).alias("count")).orderBy("date")


def location_counts(base: DataFrame, grouped: bool = False, limit: int = 15) -> DataFrame:
    """Grouped: locations of the newest row per key."""
    from jobweave.operators.listing import top_locations

    return top_locations(newest_per_key(base) if grouped else base, limit)


def location_counts_unfiltered(postings: DataFrame, seniority: str | None = None, limit: int = 15) -> DataFrame:
    """The dashboard's own ungrouped form: only a seniority filter, as one unsplit fragment."""
    chosen = postings.where(contains_ci("seniority", seniority)) if seniority else postings
    return location_counts(chosen, False, limit)


def dimension_counts(base: DataFrame, grouped: bool = False) -> DataFrame:
    """Counts of six dimensions in one pass over the base: (dimension, value, count).

    Rows are first combined to their distinct dimension values (grouped: with the key),
    so the unpivot handles combinations, not rows.  Status is left out of the grouped
    form, where it is a maximum per key (see ``by_status``).
    """
    dims = [d for d in DIMENSIONS if not (grouped and d == "status")]
    if grouped:
        columns = [*[d for d in dims if d != "company"], *KEY]
        combos = with_key(base).select(*columns).distinct()
    else:
        combos = base.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims
    ])).alias("_e")
    long = combos.select(*(KEY if grouped else ["_n"]), entries).select(
        *(KEY if grouped else ["_n"]), "_e.dimension", "_e.value"
    ).where(
        "dimension IN ('status', 'source', 'company') OR (value IS NOT NULL AND value <> '')"
    ).where("NOT (dimension = 'seniority' AND value = 'C-level')")
    if grouped:
        return long.distinct().groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))
    return long.groupBy("dimension", "value").agg(F.sum("_n").alias("count"))


# --- the whole dashboard ---------------------------------------------------------------

SETS = ["source", "category", "seniority", "work_type"]


def _one_per_key(base: DataFrame) -> DataFrame:
    """One row per key with all that the panels need of it; everything is combined before the shuffle."""
    rich = F.col("salary_min_pln").isNotNull()
    newest = F.struct(F.col("created_at").isNotNull(), -F.unix_micros(F.col("created_at").cast("timestamp")), F.col("id"))  # the first in this order
    return with_key(base).groupBy(*KEY).agg(
        F.max("status").alias("status"), F.coalesce(F.max("saved"), F.lit(False)).alias("saved"), F.coalesce(F.max("is_reposted"), F.lit(False)).alias("is_reposted"),
        *[F.collect_set(c).alias(c) for c in SETS], F.max(F.when(rich, F.col("category"))).alias("_rich_category"), F.max(rich).alias("_rich"),
        F.max(F.col("source").isNull()).alias("_no_source"),
        F.avg(F.when(rich, F.col("salary_min_pln"))).alias("_lo"), F.avg(F.when(rich, F.col("salary_max_pln"))).alias("_hi"),
        F.min("date_added").alias("date_added"), F.min_by("location", newest).alias("location"))


def _one_per_row(base: DataFrame) -> DataFrame:
    rich = F.col("salary_min_pln").isNotNull()
    return base.select(
        "company", "status", "date_added", "location", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("saved", "is_reposted")],
        *[F.array_compact(F.array(c)).alias(c) for c in SETS], F.when(rich, F.col("category")).alias("_rich_category"), F.lit(True).alias("_rich"),
        F.col("source").isNull().alias("_no_source"), F.col("salary_min_pln").alias("_lo"), F.col("salary_max_pln").alias("_hi"))


def dashboard(base: DataFrame, grouped: bool = False) -> DataFrame:
    """(panel, value, count, avg_min, avg_max): all panels over the base at once.

    ``base`` carries the monthly range.  Grouped, a first shuffle by key makes one row of each key; a second
    one, or the only one, adds up what each row says to each panel.  Lists are whole: the caller orders
    and cuts them.  A salary panel counts the rows, or keys, with a minimum.
    """
    rows = _one_per_key(base) if grouped else _one_per_row(base)
    nothing, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def entry(panel: str, value: Column = nothing, n: Column | None = None, lo: Column = number, hi: Column = number) -> Column:
        n = F.lit(1) if n is None else n.cast("int")
        return F.struct(F.lit(panel).alias("panel"), value.alias("value"), n.alias("n"), lo.alias("lo"), hi.alias("hi"))

    def each(panel: str, values: Column) -> Column:
        return F.transform(values, lambda v: entry(panel, v))

    facet = lambda c: F.filter(F.col(c), lambda v: present(v) & (~v.isin(fv.SENIORITY_BLACKLIST) if c == "seniority" else F.lit(True)))
    rich = F.col("_rich") & F.col("_lo").isNotNull()
    with_category = F.coalesce(present(F.col("_rich_category")), F.lit(False))
    entries = F.concat(
        F.array(entry("total_jobs"), entry("status", F.col("status")), entry("saved_count", n=F.col("saved")), entry("reposted_count", n=F.col("is_reposted")),
                entry("company", F.col("company")), entry("salary_stats", n=rich, lo=F.col("_lo"), hi=F.col("_hi"))),
        each("source", F.when(F.col("_no_source"), F.array_append("source", nothing)).otherwise(F.col("source"))),
        *[each(c, facet(c)) for c in ("category", "seniority", "work_type")], each("location", F.coalesce("location", F.array().cast("array<string>"))),
        F.when(with_category, F.array(entry("salary_by_category", F.col("_rich_category"), lo=F.col("_lo"), hi=F.col("_hi")))).otherwise(F.array().cast(_ENTRIES)),
        F.when(F.col("date_added").isNotNull(), F.array(entry("added", F.col("date_added")))).otherwise(F.array().cast(_ENTRIES)))
    added = rows.select(F.inline(entries)).groupBy("panel", "value").agg(F.sum("n").alias("count"), F.avg("lo").alias("lo"), F.avg("hi").alias("hi"))
    shown = lambda c: F.when(F.col("panel") == "salary_stats", F.rint(F.nullif(F.col(c), F.lit(0.0)))).otherwise(F.round(c, 0))
    return added.select("panel", "value", "count", shown("lo").alias("avg_min"), shown("hi").alias("avg_max"))


_ENTRIES = "array<struct<panel:string,value:string,n:int,lo:double,hi:double>>"


def inference_by_model(log: DataFrame) -> DataFrame:
    """Calls, mean latency and token sums per model."""
    return log.groupBy("model").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("latency_ms").alias("avg_latency"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"),
    )


def inference_totals(by_model: DataFrame) -> DataFrame:
    """Overall figures.  The latency is weighted by all calls of a model, also those
    without a latency, so it is not the plain average."""
    weighted = F.sum(F.coalesce("avg_latency", F.lit(0.0)) * F.col("count")) / F.sum("count")
    return by_model.agg(
        F.round(weighted, 1).alias("avg_latency_ms"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("total_output_tokens"),
    )
