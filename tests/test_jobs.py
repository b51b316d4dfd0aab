"""Whole jobs and the operators under them, on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from repolytics.functions.json import first_alternative
from repolytics.operators import search as H
from repolytics.operators import sets as T
from repolytics.plans import files as PF
from repolytics.plans import integrity as PI
from repolytics.plans.reports import FailedIdentifiers
from repolytics.sources import readers as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "document, want",
    [
        ('{"a": 1, "b": "x"}', "1"),
        ('{"a": null, "b": "x"}', "x"),
        ('{"a": false, "b": "x"}', "x"),
        ('{"a": "false", "b": "x"}', "false"),
        ('{"a": "", "b": "x"}', ""),
        ('{"a": true}', "true"),
        ('{"a": 0}', "0"),
        ('{"b": {"c": [1, null]}}', '{"c":[1,null]}'),
        ('{"a": false, "b": null}', "none"),
        ("no json", "none"),
        (None, "none"),
    ],
)
def test_first_alternative_by_type(spark, document, want):
    df = spark.createDataFrame([(document,)], "d string")
    assert df.select(first_alternative("d", "$.a", "$.b", default="none")).first()[0] == want


def test_many_checks_scan_a_table_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    found = T.checks(spark.read.parquet(f"{tmp_path}/t"), {f"below {i}": ("error" if i % 2 else "warning", F.col("id") < i) for i in range(5)})
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert rows(T.validation_report([found])) == [("below 1", "error", 1), ("below 2", "warning", 2), ("below 3", "error", 3), ("below 4", "warning", 4)]
    empty = T.checks(spark.range(0), {"any": ("error", F.lit(True))})
    assert rows(empty) == [("any", "error", 0)]


def test_search_reads_postings_only(spark, tmp_path):
    docs = [(1, "The cat. the CAT-the"), (2, None), (3, ""), (4, "dog café"), (5, "cat"), (6, "cat the")]
    df = spark.createDataFrame(docs, "id int, text string")
    assert rows(H.postings(df, "id", "text").where("id = 1")) == [("cat", 1, 2), ("the", 1, 3)]
    path = H.write_postings(df, "id", "text", f"{tmp_path}/p")
    hits = H.search(spark, path, "id", ["Cat", "the", "cat"])
    assert rows(hits) == [(1, 1, 5), (2, 6, 2), (3, 5, 1)]
    assert rows(H.search(spark, path, "id", ["cat", "the"], limit=2)) == [(1, 1, 5), (2, 6, 2)]
    assert rows(H.search(spark, path, "id", ["CAFÉ"])) == [(1, 4, 1)] and H.search(spark, path, "id", ["absent"]).count() == 0
    scan = spark.read.parquet(path).where(F.col("term").isin("cat"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan and "EqualTo(term,cat)" in scan


def test_folder_registration(spark, tmp_path):
    os.makedirs(f"{tmp_path}/up/sub")
    for name, data in (("a.nc", b"abc"), ("b.nc", b"x" * 50), ("sub/c.nc", b"?"), ("d.txt", b"no")):
        with open(f"{tmp_path}/up/{name}", "wb") as f:
            f.write(data)
    files = R.file_inventory(spark, f"{tmp_path}/up", "*.nc")
    assert {os.path.basename(r["path"]): r["length"] for r in files.collect()} == {"a.nc": 3, "b.nc": 50, "c.nc": 1}
    answers = files.select("path", F.lit("s3://1").alias("storage"), F.when(F.col("path").endswith("c.nc"), "ERROR").otherwise("OK").alias("status"))
    good, refused = PF.register_folder(spark, f"{tmp_path}/up", answers, most=49)
    record = good.select("record").first()[0]
    assert good.count() == 1 and '"fileName":"a.nc"' in record and "a9993e364706816aba3e25717850c26c9cd0d89d" in record
    assert rows(refused.select(F.element_at(F.split("path", "/"), -1), "reason")) == [("b.nc", "too large"), ("c.nc", "error")]
    none, all_refused = PF.register_folder(spark, f"{tmp_path}/up", answers.limit(0))
    assert none.count() == 0 and {r["reason"] for r in all_refused.collect()} == {"missing"}
    with pytest.raises(FileNotFoundError):
        PF.register_folder(spark, f"{tmp_path}/up", answers, glob="*.none")


def catalog_tables(spark):
    make = spark.createDataFrame
    return {
        "template": make([(1, "one", 10), (2, "two", None), (3, "three", 99)], "id int, name string, owner_id int"),
        "parent": make([(10, "B", 1), (11, "A", 1), (12, "C", 2), (13, "D", None)], "id int, name string, default_template_id int"),
        "block": make([(1, "geo"), (2, "citation"), (3, "unused")], "id int, name string"),
        "enabled": make([(10, 1), (10, 2), (11, 2), (11, 2)], "parent_id int, block_id int"),
        "template_field": make([(1, 100), (1, 101), (1, 100), (2, 102)], "template_id int, field_type_id int"),
        "field_type": make([(100, "title", 2, 5), (101, "place", 1, 1), (102, "author", 2, 2)], "id int, name string, block_id int, display_order int"),
        "level": make([(11, 100, False, True)], "parent_id int, field_type_id int, include boolean, required boolean"),
    }


def test_template_check_from_catalog_tables(spark):
    check = PI.TemplateCheck(catalog_tables(spark))
    owners = {r["template_name"]: (r["parent_name"], r["default_template_id"]) for r in check.associations().collect()}
    assert owners == {"one": ("B", 1), "two": (None, None), "three": (None, None)}
    # parent 10 is owner and uses the template as its default: listed once
    assert [tuple(r) for r in check.coverage().orderBy("position").collect()] == [
        (1, "one", "A", "citation", "ENABLED"),
        (2, "one", "A", "geo", "MISSING"),
        (3, "one", "B", "citation", "ENABLED"),
        (4, "one", "B", "geo", "ENABLED"),
        (5, "two", "C", "citation", "MISSING"),
    ]
    levels = [tuple(r)[1:] for r in check.levels().orderBy("position").collect()]
    assert levels[:3] == [("one", "A", "place", True, False), ("one", "A", "title", False, True), ("one", "A", "title", False, True)]
    assert levels[3:] == [("one", "B", "place", True, False), ("one", "B", "title", True, False), ("one", "B", "title", True, False), ("two", "C", "author", True, False)]
    for asked in ("2", "two"):
        assert rows(PI.TemplateCheck(catalog_tables(spark), asked).coverage()) == [(1, "two", "C", "citation", "MISSING")]


def test_error_surroundings(spark):
    text = ["sw field", "x", 'multiValued="false"', "artifact", "y", "software", 'multiValued="false" sw']
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text, 1)] + [("g", 1, "sw")], "file string, n bigint, line string")
    found = PI.error_surroundings(lines, "file", "n", "line", 'multiValued="false"', "sw|software|artifact", 3)
    assert rows(found) == [(1, "f", 1, "sw field"), (2, "f", 4, "artifact"), (3, "f", 6, "software")]


def test_lines_of_one_moment_follow_the_log(spark):
    log = [("p", f"/dataset/{n}", "GET", "1", "2024-01-01 00:00:00.250000", i) for i, n in enumerate((9, 10, 8))] + [("q", "/a", "GET", "1", "2024-01-01 00:00:00.250000", 9)]
    df = spark.createDataFrame(log, "pid string, uri string, method string, ip string, t string, pos int").select("*", F.col("t").cast("timestamp_ntz").alias("time")).drop("t")
    report = FailedIdentifiers(df.repartition(4), spark.createDataFrame([], "ip string"), "https://h")
    got = [r["line"] for r in report.details().where("pid = 'p'").orderBy("position").collect()]
    assert got == [f"GET /dataset/{n} from 1 at 2024-01-01 00:00:00.250000" for n in (9, 10, 8)]
    one_each = FailedIdentifiers(df.where("uri <> '/dataset/10' and uri <> '/dataset/8'"), spark.createDataFrame([], "ip string"), "https://h")
    assert rows(one_each.ranked().select("rank", "pid")) == [(1, "p"), (2, "q")]


def test_a_hot_target_is_split(spark):
    """One target may own most entries: the status join shuffles both sides for itself."""
    entries = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("target"))
    none = spark.createDataFrame([], "target string")
    statuses = spark.createDataFrame([("hot", 403), ("hot", 403), ("950", 200)], "target string, status int")
    plan = PF.download_plan(entries, none, none, statuses, "target", True)
    assert plan.where("action = 'skip'").count() == 900 and plan.count() == 1000


def test_postings_take_a_text_apart_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, " ,")], "id int, text string")
    text = H.postings(df, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(") == 1
    assert rows(H.postings(df, "id", "text")) == [("a", 1, 1), ("b", 1, 2)]
    # the texts are not sampled for ranges before they are written
    seen = spark.sparkContext.accumulator(0)
    df.rdd.map(lambda r: seen.add(1) or r).toDF(df.schema).createOrReplaceTempView("counted_texts")
    H.write_postings(spark.table("counted_texts"), "id", "text", f"{tmp_path}/once")
    assert seen.value == 4 and spark.read.parquet(f"{tmp_path}/once").count() == 2
