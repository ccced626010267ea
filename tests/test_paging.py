"""Pages through a directory of ranges."""

import pytest
from pyspark.sql import functions as F

from jobweave.operators.paging import OrderDirectory, page_of, sorted_by

ORDER = [("v", "desc_nulls_last"), ("id", "asc")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1_000).withColumns({"v": F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(50))), "more": F.lit("x")})


@pytest.mark.parametrize("page", [1, 2, 17, 33, 34, 35])
def test_pages_are_those_of_the_whole_order(rows, page):
    want = [r.id for r in rows.orderBy(*sorted_by(ORDER)).collect()][(page - 1) * 30:page * 30]
    assert [r.id for r in page_of(rows, ORDER, page, 30, shallow=60).collect()] == want
    directory = OrderDirectory.build(rows, sorted_by(ORDER), ranges=9)
    assert [r.id for r in directory.page(page, 30).collect()] == want


def test_a_page_reads_the_ranges_it_lies_in(rows):
    """Of nine ranges a page of 30 rows reads two at most, and the sort sees no more than they hold."""
    directory = OrderDirectory.build(rows, sorted_by(ORDER), ranges=9)
    assert sum(n for _, _, n in directory.starts) == 1_000 and len(directory.starts) > 5
    for page in (1, 15, 33):
        plan = directory.page(page, 30)._jdf.queryExecution().executedPlan().toString()
        listed = [line for line in plan.split("PartitionFilters")[1].split("]")[:1]]
        first = (page - 1) * 30
        within = [k for k, before, n in directory.starts if before < first + 30 and before + n > first]
        assert len(within) <= 2 and listed
        read = directory.rows.where(F.col("_range").isin(within)).count()
        assert read < 450
