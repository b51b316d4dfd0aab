"""Usage and description queries over every line, with an order too long for one list, an order without lines and null values."""

import datetime as dt
import json

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from compare import connect, difference


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("usage"))
    for name in "region nation customer supplier part events documents embeddings pages benchmark labels conversations".split():
        pq.write_table(spark.range(1).toArrow(), f"{path}/{name}.parquet")
    day = dt.datetime(1997, 5, 28)
    orders = [(1, 7, day, "5-LOW"), (2, 7, day, "5-LOW"), (3, 8, dt.datetime(1997, 6, 1), "1-URGENT")]
    names = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]
    pq.write_table(spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string").select(names).toArrow(), f"{path}/orders.parquet")
    lines = [(1, i, 1, 2, float(i % 50), "AAAR"[i % 4]) for i in range(2500)] + [(3, 1, 1, 2, 5.0, "A"), (3, 2, 1, 2, 5.0, "A"), (3, 2, 1, 2, 5.0, None), (9, 1, 1, 2, 4.0, "R")]
    schema = "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string"
    pq.write_table(spark.createDataFrame(lines, schema).toArrow(), f"{path}/lineitem.parquet")
    return path


QUERIES = ["agg_06_usage_totals", "agg_07_empty_split", "flt_09_empty_array", "prj_03_nested_shape", "jsn_04_chain_explode", "jsn_06_membership", "src_02_rows_at_key", "job_03_usage_check"]


@pytest.mark.parametrize("name", QUERIES)
def test_every_line_is_an_instance(spark, folder, name):
    assert difference(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) is None


def test_totals_count_lines(spark, folder):
    assert [r["n"] for r in entry.queries()["agg_06_usage_totals"](spark, folder).collect()] == [625]


def test_descriptions_are_whole(spark, folder):
    """One document for an order, however many files it has."""
    assert difference(entry.queries()["doc_04_export_description"](spark, folder), connect(folder), entry.oracle_sql()["doc_04_export_description"]) is None
    documents = {r["o_orderkey"]: json.loads(r["document"]) for r in entry.queries()["doc_04_export_description"](spark, folder).collect()}
    assert {k: len(d["distribution"]) for k, d in documents.items()} == {1: 2500, 2: 0, 3: 3}


def test_names_are_joined(spark):
    listed = entry.queries()["agg_12_joined_names"](spark, "/root/testdata/sf0.001").collect()
    assert len(listed) == len({r["p_type"] for r in listed}) and all(r["names"] == ",".join(sorted(set(r["names"].split(",")))) for r in listed)
    assert any("," in r["names"] for r in listed)
