"""Every registered query: against its SQL twin, or by the rows it yields."""

import pytest
from comparing import compare, duck

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert 0 < len(rows) <= 20 and set(rows[0].asDict()) == {"category", "count"}


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
