"""All panels from one plan."""

import pytest
from pyspark.sql import functions as F

from jobweave.operators import analytics
from jobweave.sources import derived


@pytest.fixture(scope="module")
def paid(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paid") / "t")
    derived.salaried(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("grouped, exchanges", [(False, 1), (True, 2)])
def test_one_plan(paid, grouped, exchanges):
    """Thirteen panels, one scan, and no more shuffles than keys and panels need."""
    panels = analytics.dashboard(paid, grouped)
    plan = panels._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("FileScan") == 1
    assert panels.select("panel").distinct().count() == 13


@pytest.mark.parametrize("grouped", [False, True])
def test_panels_are_those_of_each_query(paid, grouped):
    got = {(r.panel, r.value): r for r in analytics.dashboard(paid, grouped).collect()}
    for panel, fn, column in (("status", analytics.by_status, "status"), ("source", analytics.by_source, "source"), ("category", analytics.by_category, "category"),
                              ("work_type", analytics.by_work_type, "work_type"), ("seniority", analytics.by_seniority, "seniority"), ("added", analytics.added_over_time, "date")):
        rows = fn(paid, grouped).collect()
        assert rows and all(got[panel, r[column]]["count"] == r["count"] for r in rows)
    for panel, fn in (("total_jobs", analytics.total_jobs), ("saved_count", analytics.saved_count), ("reposted_count", analytics.reposted_count)):
        assert got[panel, None]["count"] == fn(paid, grouped).first()[0]
    stats = analytics.salary_stats(paid, grouped).first()
    assert (got["salary_stats", None].avg_min, got["salary_stats", None].avg_max) == (stats.avg_min_pln, stats.avg_max_pln)
    for r in analytics.location_counts(paid, grouped).collect():
        assert got["location", r.location]["count"] == r["count"]


def test_empty_and_null(spark, paid):
    assert analytics.dashboard(paid.limit(0)).count() == 0 and analytics.dashboard(paid.limit(0), True).count() == 0
    bare = paid.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in paid.schema.fields])
    assert {(r.panel, r["count"]) for r in analytics.dashboard(bare).collect()} == {
        ("total_jobs", 3), ("status", 3), ("source", 3), ("company", 3), ("saved_count", 0), ("reposted_count", 0), ("salary_stats", 0)}
