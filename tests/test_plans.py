"""Shape of the physical plans."""

import re

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from repolytics.operators import aggregates, joins, ordering, sequence

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["join_03_coverage_matrix", "join_04_effective_levels", "join_11_classify", "join_14_missing_required", "agg_08_consistency", "job_02_resolution_backfill", "job_03_usage_check", "job_06_options_to_add"],
)
def test_no_pairwise_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_month_bounds_reach_the_scan(spark):
    text = plan(spark, "flt_01_in_month")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate.*LessThan\(o_orderdate", text)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


@pytest.mark.parametrize("name, shuffles", [("join_16_table_diff", 1), ("win_07_current_state", 1), ("win_06_contiguous_months", 1), ("agg_13_run_verdict", 1), ("win_02_context_of_text", 0), ("doc_02_flatten_metadata", 0), ("jsn_03_listing_lookup", 0)])
def test_number_of_shuffles(spark, name, shuffles):
    assert plan(spark, name).count("Exchange hashpartitioning") == shuffles


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n[:3] in ("str", "dt_", "hsh", "flt", "agg", "win", "doc")])
def test_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Arrow" not in text


@pytest.fixture
def small_partitions(spark):
    """Thresholds of adaptive execution scaled down to the size of a test."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark, n=300_000):
    """A third of the rows on one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    return spark.range(0, n, 1, 16).select(key.alias("k"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


@pytest.mark.parametrize(
    "make",
    [
        lambda df, keys: joins.with_children(keys, df, "k"),
        lambda df, keys: joins.exclude_denied(df, keys.where("k % 2 = 1 and k <> 7"), "k")[0],
        lambda df, keys: joins.pending(df, keys.where("k < 5"), keys.where("k < 3"), "k"),
        lambda df, keys: aggregates.duplicate_keys(df, "k", "pad"),
        lambda df, keys: sequence.after_flag(df, ["k"], "v", F.col("v") < 5000, F.col("v") > 100),
    ],
    ids=["with_children", "exclude_denied", "pending", "duplicate_keys", "after_flag"],
)
def test_joins_split_a_hot_key(spark, small_partitions, make):
    df = hot_rows(spark)
    result = make(df, spark.range(5000).select(F.col("id").alias("k")))
    assert result.collect()
    assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()

