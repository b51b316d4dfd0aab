"""Cases outside the given tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolytics.operators import aggregates as A
from repolytics.operators import filters as L
from repolytics.operators import joins as J
from repolytics.operators import sequence as S
from repolytics.sources.readers import read_tsv


def test_ragged_line_fails_whatever_is_selected(spark, tmp_path):
    path = tmp_path / "log.tsv"
    path.write_text("pid\turi\na\tb\nc\n")
    log = read_tsv(spark, str(path), T.StructType([T.StructField("pid", T.StringType()), T.StructField("uri", T.StringType())]))
    for action in (log.count, log.select("pid").collect):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
            action()


def test_as_of_null_keys_match_nothing(spark):
    left = spark.createDataFrame([(None, 5, "l0"), (1, 5, "l1")], "k long, t long, l string")
    right = spark.createDataFrame([(None, 1, "r0"), (1, 2, "r1")], "k long, t2 long, r string")
    got = J.as_of_join(left, right, "k", "t", "t2", ["r"]).select("l", "r").collect()
    assert sorted((r["l"], r["r"]) for r in got) == [("l0", None), ("l1", "r1")]


def test_groups_without_rows_lack_everything(spark):
    df = spark.createDataFrame([(1, "a")], "g long, n string")
    groups = spark.createDataFrame([(1,), (2,), (2,)], "g long")
    got = J.missing_required(df, "n", ["a", "b"], "g", groups).collect()
    assert sorted(tuple(r) for r in got) == [(1, "b"), (2, "a"), (2, "b")]


def test_baseline_reports_both_sides(spark):
    now = spark.createDataFrame([("x", 9), ("new", 1)], "m string, n long")
    base = spark.createDataFrame([("x", 10), ("gone", 4)], "m string, n long")
    got = {r["m"]: (r["status"], r["floor_ok"]) for r in A.compare_baseline(now, base, "m", "n").collect()}
    assert got == {"x": ("both", True), "new": ("now_only", None), "gone": ("base_only", None)}


def test_changes_keep_null_names(spark):
    settings = spark.createDataFrame([(None, "v"), ("a", "1")], "name string, content string")
    none = settings.where("name = 'z'")
    got = J.apply_changes(settings, "name", "content", none, ["a"], ["b%"]).collect()
    assert [tuple(r) for r in got] == [(None, "v")]


def test_context_splits_a_text_once(spark):
    text = "\n".join("hit" if i % 3 == 0 else "x" for i in range(30_000))
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.size(S.context_of_text("t", "hit", 0, 1)).alias("n")).first()["n"]
    assert got == 20_000


def test_expired_bound_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,id) as ts, 'a' as n from range(20)")
    rows.write.parquet(path)
    found = L.expired(spark.read.parquet(path), "ts", 4, "n", "a%", "2024-01-10 00:00:00")
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(ts" in plan.split("PushedFilters")[1]
