"""Salary conversion and the fixes that recompute stored values."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.catalog import query
from jobweave.catalog.views import PAID, PLAIN
from jobweave.functions import salary
from jobweave.operators import analytics
from jobweave.plans import changes
from jobweave.sources import derived


@query("salary_normalized", PAID + " SELECT id, salary_period, salary_min_pln, salary_max_pln FROM paid")
def salary_normalized(spark, sf):
    return derived.salaried(spark, sf).select("id", "salary_period", "salary_min_pln", "salary_max_pln")


@query("salary_period_explicit_first", PLAIN + """ SELECT id, CASE lower(explicit) WHEN 'hour' THEN 'hourly' WHEN 'd' THEN 'daily' WHEN 'annual' THEN 'yearly' ELSE
 CASE WHEN salary_type LIKE '%/h%' THEN 'hourly' WHEN salary_type LIKE '%/day%' THEN 'daily' WHEN salary_currency='PLN' AND salary_max>0 AND salary_max<500 THEN 'hourly'
 WHEN salary_currency IN ('USD','EUR') AND salary_max>0 AND salary_max<120 THEN 'hourly' ELSE 'monthly' END END AS period
 FROM (SELECT *, CASE id%4 WHEN 0 THEN 'Hour' WHEN 1 THEN 'd' WHEN 2 THEN 'annual' ELSE 'weekly' END AS explicit FROM postings)""")
def salary_period_explicit_first(spark, sf):
    k = F.col("id") % 4
    explicit = F.when(k == 0, "Hour").when(k == 1, "d").when(k == 2, "annual").otherwise("weekly")
    return derived.postings(spark, sf).select(
        "id", salary.detect_period(F.col("salary_type"), F.col("salary_max"), F.col("salary_currency"), explicit).alias("period")
    )


@query("rates_from_quotes", """ SELECT n_name AS currency, 1.0 / (n_nationkey + 1) AS rate_to_pln FROM nation UNION ALL SELECT 'PLN', 1.0""".replace(
    "1.0 / (n_nationkey + 1)", "CAST(1.0 AS DOUBLE) / (n_nationkey + 1)").replace("'PLN', 1.0", "'PLN', CAST(1.0 AS DOUBLE)"))
def rates_from_quotes(spark, sf):
    quotes = derived.table(spark, sf, "nation").select(F.col("n_name").alias("currency"), (F.col("n_nationkey") + 1).cast("double").alias("rate"))
    return salary.rates_from_base_quotes(quotes)


@query("salary_backfill", PAID + """ SELECT id, (salary_min IS NOT NULL OR salary_max IS NOT NULL) AS updated,
 CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN salary_min_pln ELSE -1.0::DOUBLE END AS salary_min_pln,
 CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN salary_period ELSE 'stale' END AS salary_period FROM paid""")
def salary_backfill(spark, sf):
    stale = derived.postings(spark, sf).withColumns({
        "salary_min_pln": F.lit(-1.0), "salary_max_pln": F.lit(-1.0), "salary_period": F.lit("stale"),
    })
    return changes.backfill_salaries(stale).select("id", "updated", "salary_min_pln", "salary_period")


@query("hourly_estimates", PAID + """ SELECT id, CAST(floor(salary_min_pln / 160 + 0.5) AS BIGINT) AS hourly_min, CAST(floor(salary_max_pln / 160 + 0.5) AS BIGINT) AS hourly_max
 FROM paid WHERE salary_min_pln IS NOT NULL AND salary_max_pln IS NOT NULL""")
def hourly_estimates(spark, sf):
    p = derived.salaried(spark, sf).where("salary_min_pln IS NOT NULL AND salary_max_pln IS NOT NULL")
    return p.select("id", salary.hourly_estimate(F.col("salary_min_pln")).alias("hourly_min"), salary.hourly_estimate(F.col("salary_max_pln")).alias("hourly_max"))


@query("salary_range_spans", PAID + """ SELECT category, coalesce(lo, 0) AS range_min, greatest(0, coalesce(hi, coalesce(lo, 0)) - coalesce(lo, 0)) AS range_span FROM (
 SELECT category, round(avg(salary_min_pln), 0) AS lo, round(avg(salary_max_pln), 0) AS hi FROM paid WHERE salary_min_pln IS NOT NULL AND category <> '' GROUP BY category)""")
def salary_range_spans(spark, sf):
    bars = analytics.salary_by_category(derived.salaried(spark, sf))
    return bars.select(
        "category", F.coalesce("avg_min", F.lit(0.0)).alias("range_min"), salary.range_span(F.col("avg_min"), F.col("avg_max")).alias("range_span")
    )


@query("pay_period_beside_url", """SELECT o_orderkey AS id, CASE WHEN o_orderkey%3 = 0 AND o_orderkey%2 = 0 THEN 'hourly' ELSE 'monthly' END AS period FROM orders""")
def pay_period_beside_url(spark, sf):
    """A URL names hourly pay where the posting gives a type."""
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://x.example/"), F.when(k % 3 == 0, "100-USD/h/").otherwise("full/"), k)
    kind = F.when(k % 2 == 0, F.lit("B2B"))
    period = salary.detect_period(kind, F.col("o_totalprice"), F.lit("CHF"), url=url)
    return derived.table(spark, sf, "orders").select(k.alias("id"), period.alias("period"))
