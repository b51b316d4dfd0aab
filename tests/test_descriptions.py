"""Dataset descriptions whose texts are built where they are written: the same fragments, few columns dealt out."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from repolytics.catalog import sources
from repolytics.operators.documents import description_fragment, export_description, whole_descriptions
from repolytics.sources.shapes import description_columns, description_sources, description_tables, description_ties


def tables(spark):
    """Copies of orders and lines, null values in every column, lines that tie, a key without lines and lines without one."""
    orders = [(1, 7, "5-LOW"), (1, 71, "5-LOW"), (1, 7, "5"), (1, None, None), (1, 7, "5-LOW"), (2, 7, None), (3, 8, "4-NOT"), (3, 8, "4-NOT SPECIFIED"), (None, 9, "1-URGENT"), (4, None, "2-HIGH")]
    lines = [(k, n, p, s, q, f) for k in (1, 3, 9) for n in (1, 10, None) for p in (2, 21, None) for s in (3, None) for q in (5.0, 50.0, None) for f in ("R", "A", None)]
    lines += lines[:40] + [(2, 1, 1, 1, 1.0, "R")] * 3 + [(None, 1, 1, 1, 1.0, "R")]
    return (
        spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string"),
        spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string"),
    )


@pytest.mark.parametrize("long_series", [2_000_000, 50])
def test_late_texts_are_the_fragments(spark, long_series):
    given, shape = tables(spark), description_columns()
    order = ["@id", "contentSize"]
    want = export_description(*description_tables(*given), "o_orderkey", order)
    placed = export_description(*description_sources(*given), "o_orderkey", order, long_series, shape, description_ties())
    found = placed.select("o_orderkey", "place", description_fragment(shape).alias("fragment"))
    rows = [sorted(map(repr, df.collect())) for df in (want, found)]
    assert len(rows[0]) > 300 and rows[0] == rows[1]


def test_the_sink_deals_out_no_texts(spark, monkeypatch):
    """Neither for the numbering nor for the files: texts are built above every exchange."""
    plans = []

    def write(rows, path, name, compression="none", fragment=F.col("fragment")):
        plans.append((rows.columns, rows._jdf.queryExecution().optimizedPlan().toString()))
        return given(rows, path, name, compression, fragment)

    given = sources.W.write_documents
    monkeypatch.setattr(sources.W, "write_documents", write)
    assert entry.queries()["snk_02_documents"](spark, "/root/testdata/sf0.001").count() > 0
    [(columns, plan)] = plans
    assert "fragment" not in columns
    dealt = plan[plan.index("RepartitionByExpression") :]
    assert "to_json" not in dealt and "md5" not in dealt


@pytest.mark.parametrize("part_size,long_series", [(1000, 2_000_000), (7, 2_000_000), (7, 50), (1, 2_000_000)])
def test_documents_are_joined_from_numbered_parts(spark, part_size, long_series):
    """In parts of whatever size: all files of a dataset, in their order, in one document."""
    datasets, files = description_tables(*tables(spark))
    order = ["@id", "contentSize"]
    found = whole_descriptions(datasets, files, "o_orderkey", order, part_size, long_series).collect()
    rank = lambda e: tuple((e.get(c) is not None, e.get(c) or "") for c in order)
    sizes = {r["o_orderkey"]: r["n"] for r in files.groupBy("o_orderkey").agg(F.count("*").alias("n")).collect()}
    assert len(found) == datasets.count()
    for r in found:
        entries = json.loads(r["document"])["distribution"]
        assert len(entries) == (sizes.get(r["o_orderkey"], 0) if r["o_orderkey"] is not None else 0)
        assert entries == sorted(entries, key=rank)
    # the text of all files of a key, as its fragments give it
    fragments = export_description(datasets.dropDuplicates(["o_orderkey"]), files, "o_orderkey", order).where("place > 0 and fragment not like ']%'")
    listed = fragments.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("place", "fragment")))["fragment"].alias("l")).collect()
    texts = {r["o_orderkey"]: "".join(r["l"]) for r in listed if r["o_orderkey"] is not None}
    assert set(texts) == {1, 2, 3}
    assert all(r["document"].split('"distribution":[', 1)[1].startswith(texts.get(r["o_orderkey"], "") + "]") for r in found)


def test_the_sql_of_descriptions_numbers_files():
    assert "row_number() OVER (PARTITION BY o_orderkey" in entry.oracle_sql()["doc_04_export_description"]
