"""Dashboard aggregates, per row and per duplicate key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobweave import schema
from jobweave.catalog import query
from jobweave.catalog.views import LOG, PAID, PLAIN
from jobweave.operators import analytics, filters
from jobweave.operators.filters import PostingFilter
from jobweave.session import ensure_checkpoint_dir
from jobweave.sources import derived
from jobweave.streaming.metrics_stream import append_log, daily_metrics

_KEYS = "count(DISTINCT (company, lower(title)))"


def _pair(name: str, fn, plain: str, grouped: str, paid: bool = False, **kw) -> None:
    prefix = PAID if paid else PLAIN

    @query(name, f"{prefix} {plain}")
    def per_row(spark, sf):
        return fn(derived.salaried(spark, sf) if paid else derived.postings(spark, sf), False, **kw)

    @query(f"{name}_grouped", f"{prefix} {grouped}")
    def per_key(spark, sf):
        return fn(derived.salaried(spark, sf) if paid else derived.postings(spark, sf), True, **kw)


_pair(
    "total_jobs", analytics.total_jobs,
    "SELECT CAST(count(*) AS BIGINT) AS total_jobs FROM postings", f"SELECT CAST({_KEYS} AS BIGINT) AS total_jobs FROM postings",
)
_pair(
    "by_status", analytics.by_status,
    "SELECT status, CAST(count(*) AS BIGINT) AS count FROM postings GROUP BY status",
    """SELECT status, CAST(count(*) AS BIGINT) AS count FROM (SELECT max(status) AS status FROM postings
 GROUP BY company, lower(title)) GROUP BY status""",
)
_pair(
    "saved_count", analytics.saved_count,
    "SELECT CAST(count(*) AS BIGINT) AS saved_count FROM postings WHERE saved",
    f"SELECT CAST({_KEYS} AS BIGINT) AS saved_count FROM postings WHERE saved",
)
_pair(
    "reposted_count", analytics.reposted_count,
    "SELECT CAST(count(*) AS BIGINT) AS reposted_count FROM postings WHERE is_reposted",
    f"SELECT CAST({_KEYS} AS BIGINT) AS reposted_count FROM postings WHERE is_reposted",
)


def _bucket(column: str, where: str, limit: str, keyed: bool) -> str:
    return (
        f"SELECT {column}, CAST({_KEYS if keyed else 'count(*)'} AS BIGINT) AS count FROM postings WHERE {where} "
        f"GROUP BY {column} ORDER BY count DESC, {column} {limit}"
    )


for _name, _fn, _column, _where, _limit in (
    ("by_source", analytics.by_source, "source", "true", ""),
    ("by_category", analytics.by_category, "category", "category <> ''", "LIMIT 20"),
    ("by_seniority", analytics.by_seniority, "seniority", "seniority <> '' AND seniority <> 'C-level'", ""),
    ("by_work_type", analytics.by_work_type, "work_type", "work_type <> ''", ""),
    ("top_companies", analytics.top_companies, "company", "true", "LIMIT 15"),
):
    _pair(_name, _fn, _bucket(_column, _where, _limit, False), _bucket(_column, _where, _limit, True))

_pair(
    "salary_stats", analytics.salary_stats,
    """SELECT CAST(round_even(nullif(avg(salary_min_pln), 0), 0) AS DOUBLE) AS avg_min_pln,
 CAST(round_even(nullif(avg(salary_max_pln), 0), 0) AS DOUBLE) AS avg_max_pln FROM paid""",
    """SELECT CAST(round_even(nullif(avg(am), 0), 0) AS DOUBLE) AS avg_min_pln, CAST(round_even(nullif(avg(ax), 0), 0) AS DOUBLE) AS avg_max_pln
 FROM (SELECT avg(salary_min_pln) AS am, avg(salary_max_pln) AS ax FROM paid WHERE salary_min_pln IS NOT NULL GROUP BY company, lower(title))""",
    paid=True,
)
_pair(
    "salary_by_category", analytics.salary_by_category,
    """SELECT category, round(avg(salary_min_pln), 0) AS avg_min, round(avg(salary_max_pln), 0) AS avg_max FROM paid
 WHERE salary_min_pln IS NOT NULL AND category <> '' GROUP BY category ORDER BY avg(salary_max_pln) DESC NULLS FIRST, category LIMIT 15""",
    """SELECT category, round(avg(am), 0) AS avg_min, round(avg(ax), 0) AS avg_max FROM (SELECT avg(salary_min_pln) AS am, avg(salary_max_pln) AS ax,
 max(category) AS category FROM paid WHERE salary_min_pln IS NOT NULL GROUP BY company, lower(title)) WHERE category <> ''
 GROUP BY category ORDER BY avg(ax) DESC NULLS FIRST, category LIMIT 15""",
    paid=True,
)
_pair(
    "added_over_time", analytics.added_over_time,
    "SELECT date_added AS date, CAST(count(*) AS BIGINT) AS count FROM postings GROUP BY date_added",
    "SELECT date, CAST(count(*) AS BIGINT) AS count FROM (SELECT min(date_added) AS date FROM postings GROUP BY company, lower(title)) GROUP BY date",
)
_pair(
    "location_counts", analytics.location_counts,
    "SELECT location, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(location) AS location FROM postings) GROUP BY location ORDER BY count DESC, location LIMIT 15",
    """SELECT location, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(location) AS location FROM (SELECT location, row_number() OVER (
 PARTITION BY company, lower(title) ORDER BY created_at DESC NULLS FIRST, id) AS rn FROM postings) WHERE rn = 1)
 GROUP BY location ORDER BY count DESC, location LIMIT 15""",
)


@query("location_counts_dashboard_rule", PLAIN + """ SELECT location, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(location) AS location
 FROM postings WHERE seniority ILIKE '%urgent%') GROUP BY location ORDER BY count DESC, location LIMIT 15""")
def location_counts_dashboard_rule(spark, sf):
    return analytics.location_counts_unfiltered(derived.postings(spark, sf), "urgent")


_DIMENSION_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, {{count}} AS count FROM postings WHERE {w} GROUP BY {d}"
    for d, w in (
        ("status", "true"), ("source", "true"), ("category", "category <> ''"), ("seniority", "seniority <> '' AND seniority <> 'C-level'"),
        ("work_type", "work_type <> ''"), ("company", "true"),
    )
)


@query("dimension_counts", PLAIN + " " + _DIMENSION_SQL.format(count="CAST(count(*) AS BIGINT)"))
def dimension_counts(spark, sf):
    return analytics.dimension_counts(derived.postings(spark, sf))


@query("dimension_counts_grouped", PLAIN + " SELECT * FROM (" + _DIMENSION_SQL.format(count=f"CAST({_KEYS} AS BIGINT)") + ") WHERE dimension <> 'status'")
def dimension_counts_grouped(spark, sf):
    return analytics.dimension_counts(derived.postings(spark, sf), True)


def _panel(panel: str, value: str, rows: str, n: str = "count(*)", lo: str = "NULL", hi: str = "NULL") -> str:
    group = "" if value == "NULL" else " GROUP BY 2"
    return f"SELECT '{panel}' AS panel, CAST({value} AS VARCHAR) AS value, CAST({n} AS BIGINT) AS count, CAST({lo} AS DOUBLE) AS avg_min, CAST({hi} AS DOUBLE) AS avg_max FROM {rows}{group}"


def _panels(keyed: bool) -> str:
    """Every panel by a query of its own."""
    n = _KEYS if keyed else "count(*)"
    salary = "per_key" if keyed else "paid"
    stats = "round_even(nullif(avg({0}), 0), 0)"
    lo, hi = ("am", "ax") if keyed else ("salary_min_pln", "salary_max_pln")
    rich = "per_key" if keyed else "(SELECT * FROM paid WHERE salary_min_pln IS NOT NULL)"
    return " UNION ALL ".join([
        _panel("total_jobs", "NULL", "paid", n),
        _panel("status", "status", "(SELECT max(status) AS status FROM paid GROUP BY company, lower(title))" if keyed else "paid"),
        _panel("saved_count", "NULL", "(SELECT * FROM paid WHERE saved)", n), _panel("reposted_count", "NULL", "(SELECT * FROM paid WHERE is_reposted)", n),
        *[_panel(c, c, f"(SELECT * FROM paid WHERE {w})", n) for c, w in (
            ("source", "true"), ("category", "category <> ''"), ("seniority", "seniority <> '' AND seniority <> 'C-level'"), ("work_type", "work_type <> ''"), ("company", "true"))],
        _panel("salary_stats", "NULL", salary, f"count({lo})", stats.format(lo), stats.format(hi)),
        _panel("salary_by_category", "category", f"(SELECT * FROM {rich} WHERE category <> '')", "count(*)", f"round(avg({lo}), 0)", f"round(avg({hi}), 0)"),
        _panel("added", "date", "(SELECT min(date_added) AS date FROM paid GROUP BY company, lower(title))" if keyed else "(SELECT date_added AS date FROM paid)"),
        _panel("location", "place", """(SELECT unnest(location) AS place FROM (SELECT location, row_number() OVER (
 PARTITION BY company, lower(title) ORDER BY created_at DESC NULLS FIRST, id) AS rn FROM paid) WHERE rn = 1)""" if keyed else "(SELECT unnest(location) AS place FROM paid)"),
    ])


_PER_KEY = """, per_key AS (SELECT avg(salary_min_pln) AS am, avg(salary_max_pln) AS ax, max(category) AS category FROM paid
 WHERE salary_min_pln IS NOT NULL GROUP BY company, lower(title)) """


@query("dashboard", PAID + _PER_KEY + _panels(False))
def dashboard(spark, sf):
    return analytics.dashboard(derived.salaried(spark, sf))


@query("dashboard_grouped", PAID + _PER_KEY + _panels(True))
def dashboard_grouped(spark, sf):
    return analytics.dashboard(derived.salaried(spark, sf), True)


@query("filtered_category_counts_grouped", PLAIN + f""" SELECT category, CAST({_KEYS} AS BIGINT) AS count FROM postings
 WHERE source ILIKE '%src1%' AND saved = false GROUP BY category ORDER BY count DESC, category LIMIT 20""")
def filtered_category_counts_grouped(spark, sf):
    base = filters.apply_filters(derived.postings(spark, sf), PostingFilter(source="src1", saved=False))
    return analytics.by_category(base, True)


@query("status_tab_total", PLAIN + " SELECT CAST(sum(count) AS BIGINT) AS total FROM (SELECT count(*) AS count FROM postings GROUP BY status)")
def status_tab_total(spark, sf):
    return analytics.by_status(derived.postings(spark, sf)).agg(F.sum("count").alias("total"))


@query("appended_inference_log", LOG + " SELECT model, CAST(2 * count(*) AS BIGINT) AS calls, CAST(2 * count(latency_ms) AS BIGINT) AS timed FROM log GROUP BY model")
def appended_inference_log(spark, sf):
    """The log, appended twice to a folder and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    log = schema.conform(derived.inference_log(spark, sf), schema.INFERENCE_LOG)
    for _ in range(2):
        append_log(log, path)
    return spark.read.schema(schema.INFERENCE_LOG).parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count("latency_ms").alias("timed"))


# --- model-call log ---------------------------------------------------------------------

_RECENT = LOG + ", recent AS (SELECT * FROM log WHERE created_at >= (SELECT max(created_at) FROM log) - INTERVAL 7 DAYS)"


def _recent(spark, sf):
    log = derived.inference_log(spark, sf)
    newest = log.agg(F.max("created_at").alias("_as_of")).withColumn("_one", F.lit(1))  # one row
    dated = log.withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one")
    return filters.within_days(dated, "created_at", F.col("_as_of"), 7).select(*log.columns)


@query("recent_events", _RECENT + " SELECT CAST(count(*) AS BIGINT) AS calls, CAST(count(latency_ms) AS BIGINT) AS timed FROM recent")
def recent_events(spark, sf):
    return _recent(spark, sf).agg(F.count(F.lit(1)).alias("calls"), F.count("latency_ms").alias("timed"))


@query("inference_by_model", _RECENT + """ SELECT model, CAST(count(*) AS BIGINT) AS count, round(avg(latency_ms), 6) AS avg_latency,
 CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM recent GROUP BY model""")
def inference_by_model(spark, sf):
    return analytics.inference_by_model(_recent(spark, sf)).withColumn("avg_latency", F.round("avg_latency", 6))


@query("inference_totals", _RECENT + """, m AS (SELECT model, count(*) AS n, avg(latency_ms) AS a, sum(input_tokens) AS i, sum(output_tokens) AS o FROM recent GROUP BY model)
 SELECT round(sum(coalesce(a, 0) * n) / sum(n), 1) AS avg_latency_ms, CAST(sum(n) AS BIGINT) AS total_requests, CAST(coalesce(sum(i), 0) AS BIGINT) AS total_input_tokens,
 CAST(coalesce(sum(o), 0) AS BIGINT) AS total_output_tokens FROM m""")
def inference_totals(spark, sf):
    return analytics.inference_totals(analytics.inference_by_model(_recent(spark, sf)))


@query("inference_by_day", LOG + """ SELECT strftime(created_at, '%Y-%m-%d') AS day, model, CAST(count(*) AS BIGINT) AS count, CAST(sum(latency_ms) AS BIGINT) AS latency_sum,
 CAST(count(latency_ms) AS BIGINT) AS latency_count, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
 CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM log GROUP BY 1, 2""")
def inference_by_day(spark, sf):
    return daily_metrics(derived.inference_log(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")))
