"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from repolytics.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in entry.queries().items() if name in REGISTRY}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    # a small table may give an empty result, which is then empty on both sides
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) in (None, "EMPTY")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows)] == list(range(1, len(rows) + 1))
