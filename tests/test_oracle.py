"""Every query that has SQL returns exactly the rows of that SQL."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, con):
    assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "volume_spike_ratio" in df.columns
