import datetime as dt
import os

from pyspark.sql import functions as F

from repolytics.operators import sequence
from repolytics.streaming import operators as S
from repolytics.streaming.runner import DISK_STATE, PROVIDER, drain_append, drain_updates, file_stream, latest_updates, run_append

START = dt.datetime(2024, 1, 1)


def land(spark, path, rows):
    """One file per call, so that calls arrive in order."""
    spark.createDataFrame(rows, "series bigint, ts timestamp, doc_count bigint").coalesce(1).write.mode("append").parquet(path)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_stable_carries_state_over_batches(spark, tmp_path):
    path = f"{tmp_path}/in"
    # out of order inside a file, state continues in the next file
    land(spark, path, [(1, at(10), 5), (1, at(0), 4), (1, at(20), 5), (2, at(0), 0), (2, at(5), None)])
    land(spark, path, [(1, at(30), 5), (1, at(40), 5), (2, at(10), 3), (2, at(20), 4)])
    schema = spark.read.parquet(path).schema
    got = run_append(S.stream_stable(file_stream(spark, path, schema, files_per_batch=1), 2), "t-stable")
    batch = sequence.stable_at(spark.read.parquet(path), ["series"], "ts", "doc_count", 2)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in batch.collect()] == [(1, at(30), 5)]


def test_stall_samples_equal_batch(spark, tmp_path):
    path = f"{tmp_path}/in"
    land(spark, path, [(1, at(0), 1), (1, at(100), 2), (1, at(600), 2), (2, at(0), 9), (2, at(900), 9)])
    land(spark, path, [(1, at(701), 2), (1, at(900), 1), (1, at(1000), 3), (2, at(2000), 9)])
    schema = spark.read.parquet(path).schema
    got = run_append(S.stream_stall(file_stream(spark, path, schema, files_per_batch=1), 600), "t-stall")
    samples = sorted((r["series"], r["ts"], r["idle_seconds"]) for r in got.where("kind = 'sample'").collect())
    batch = sequence.stalls(spark.read.parquet(path), ["series"], "ts", "doc_count", 600)
    assert samples == sorted((r["series"], r["ts"], r["idle_seconds"]) for r in batch.collect())
    assert samples == [(1, at(701), 601), (1, at(900), 800)]


def test_silence_raises_a_timeout(spark, tmp_path):
    path = f"{tmp_path}/in"
    land(spark, path, [(1, at(0), 1), (1, at(100), 2)])
    land(spark, path, [(2, at(5000), 1)])
    land(spark, path, [(2, at(5010), 1)])
    schema = spark.read.parquet(path).schema
    got = run_append(S.stream_stall(file_stream(spark, path, schema, files_per_batch=1), 600), "t-silent")
    assert {(r["series"], r["kind"]) for r in got.collect()} == {(1, "timeout")}


def test_incremental_loads_each_file_once(spark, tmp_path):
    src, sink, state = (f"{tmp_path}/{n}" for n in ("src", "sink", "state"))
    land(spark, src, [(1, at(0), 1)])
    schema = spark.read.parquet(src).schema
    assert S.incremental(spark, src, schema, sink, state).count() == 1
    land(spark, src, [(2, at(0), 1), (3, at(0), 1)])
    assert S.incremental(spark, src, schema, sink, state).count() == 3
    assert S.incremental(spark, src, schema, sink, state).count() == 3


def test_updates_keep_the_newest_row(spark, tmp_path):
    src, sink, state = (f"{tmp_path}/{n}" for n in ("src", "sink", "state"))
    land(spark, src, [(1, at(0), 1), (1, at(10), 2)])
    land(spark, src, [(1, at(20), 3), (2, at(0), 7)])
    schema = spark.read.parquet(src).schema
    query = S.stream_state(file_stream(spark, src, schema, files_per_batch=1), ["series"], ["ts"], "doc_count")
    drain_updates(query, sink, state)
    got = latest_updates(spark, sink, query.schema, ["series"])
    assert sorted((r["series"], r["state"], r["n_actions"]) for r in got.collect()) == [(1, 3, 3), (2, 7, 1)]
    batch = sequence.current_state(spark.read.parquet(src), ["series"], ["ts"], "doc_count")
    assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_late_rows_are_bounded(spark, tmp_path):
    src, sink, state = (f"{tmp_path}/{n}" for n in ("src", "sink", "state"))
    day = 86400
    land(spark, src, [(1, at(0), 1), (1, at(60 * day), 1)])
    land(spark, src, [(1, at(5 * day), 1), (1, at(40 * day), 1)])
    land(spark, src, [(1, at(6 * day), 1)])
    schema = spark.read.parquet(src).schema
    query = S.stream_hits(file_stream(spark, src, schema, files_per_batch=1), "series", late="30 days")
    drain_updates(query, sink, state)
    days = {r["period_start"].date() for r in latest_updates(spark, sink, query.schema, ["period_start", "series"]).collect()}
    # rows are compared with the watermark of the batch before: day 5 still passes, day 6 is too late
    assert days == {at(d * day).date() for d in (0, 60, 5, 40)}


def test_each_item_once(spark, tmp_path):
    src = f"{tmp_path}/src"
    land(spark, src, [(1, at(0), 1), (1, at(1), 1), (2, at(2), 1)])
    land(spark, src, [(2, at(3), 1), (3, at(4), 1)])
    schema = spark.read.parquet(src).schema
    sink = f"{tmp_path}/once"
    drain_append(S.stream_once(file_stream(spark, src, schema, files_per_batch=1), "series"), sink, f"{tmp_path}/state")
    got = spark.read.parquet(sink)
    # keys are kept by the store on disk, and the session is left as it was
    assert any(f.endswith((".zip", ".sst")) for _, _, files in os.walk(f"{tmp_path}/state") for f in files)
    assert spark.conf.get(PROVIDER, None) != DISK_STATE
    assert sorted(r[0] for r in got.select(F.col("series")).collect()) == [1, 2, 3]


def test_late_rows_become_corrections(spark, tmp_path):
    src, sink, state = (f"{tmp_path}/{n}" for n in ("src", "sink", "state"))
    day = 86400
    land(spark, src, [(1, at(0), 1), (1, at(240 * day), 1), (2, at(239 * day), 1)])
    land(spark, src, [(1, at(3 * day), 1), (1, at(200 * day), 1), (1, at(0), 1), (2, at(241 * day), 1)])
    schema = spark.read.parquet(src).schema
    query = S.stream_all_hits(file_stream(spark, src, schema, files_per_batch=1), "series", late="45 days")
    for _ in range(2):  # the second call finds nothing new
        drain_append(query, sink, state)
    counts = spark.read.parquet(sink)
    rows = lambda df: {(r["period_start"].date(), r["key"]): r["hits"] for r in df.collect()}
    d = lambda n: at(n * day).date()
    # day 200 is within 45 days of day 240, days 0 and 3 are eight months late
    assert rows(S.late_hits(counts)) == {(d(0), "1"): 1, (d(3), "1"): 1}
    assert rows(S.reported_hits(counts)) == {(d(0), "1"): 1, (d(240), "1"): 1, (d(239), "2"): 1, (d(200), "1"): 1, (d(241), "2"): 1}
    batch = spark.read.parquet(src).groupBy(F.to_date("ts").alias("d"), F.col("series").cast("string")).count()
    assert rows(S.corrected_hits(counts)) == {(r[0], r[1]): r[2] for r in batch.collect()}


def test_no_python_holds_a_series():
    import inspect

    code = inspect.getsource(S)
    assert "pandas" not in code and "applyInPandas" not in code


def test_one_long_series_in_a_batch(spark, tmp_path):
    """A series of many samples, split over tasks, over two batches: equal to the batch operators."""
    src = f"{tmp_path}/in"
    rows = spark.range(60_000).select(F.lit(1).cast("bigint").alias("series"), (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 10)).alias("ts"), (F.col("id") / 700).cast("bigint").alias("doc_count"))
    other = rows.where("doc_count < 3").select(F.lit(2).cast("bigint").alias("series"), "ts", F.lit(9).cast("bigint").alias("doc_count"))
    for half in (F.col("ts") < at(300_000), F.col("ts") >= at(300_000)):
        rows.unionByName(other).where(half).coalesce(1).write.mode("append").parquet(src)
    batch = spark.read.parquet(src)
    stream = lambda: file_stream(spark, src, batch.schema, files_per_batch=1)
    got = run_append(S.stream_stable(stream(), 699, long_series=5000), "t-long").collect()
    want = sequence.stable_at(batch, ["series"], "ts", "doc_count", 699).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 2
    stalls = run_append(S.stream_stall(stream(), 6990, long_series=5000), "t-long-stall").where("kind = 'sample'")
    found = sequence.stalls(batch, ["series"], "ts", "doc_count", 6990)
    assert found.count() == 0 == stalls.count()
    stalls = run_append(S.stream_stall(stream(), 6900, long_series=5000), "t-long-stall").where("kind = 'sample'")
    found = sequence.stalls(batch, ["series"], "ts", "doc_count", 6900)
    columns = ["series", "ts", "idle_seconds"]
    assert found.count() > 500 and sorted(map(tuple, stalls.select(*columns).collect())) == sorted(map(tuple, found.select(*columns).collect()))


def test_a_million_samples_of_one_series_in_a_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    ts = F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))
    spark.range(1_000_000).select(F.lit(1).cast("bigint").alias("series"), ts.alias("ts"), (F.col("id") / 70_000 + 1).cast("bigint").alias("doc_count")).coalesce(1).write.parquet(src)
    batch = spark.read.parquet(src)
    got = run_append(S.stream_stable(file_stream(spark, src, batch.schema), 69_999, long_series=100_000), "t-million").collect()
    want = sequence.stable_at(batch, ["series"], "ts", "doc_count", 69_999).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] == [(1, at(69_999), 1)]
