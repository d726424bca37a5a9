"""Every registered query against its SQL, or for rows when SQL has no equivalent."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    ok, note = compare(name, QUERIES[name](spark, sf_dir), SQL.get(name), con)
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 10
    assert set(df.columns) >= {"contrast", "estimate", "adj_p_value"}


def test_names_are_consistent():
    assert set(SQL) <= set(QUERIES)
