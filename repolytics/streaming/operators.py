"""Streaming operators. Each equals its batch twin once the stream is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import keyed_join
from ..operators.ordered import LONG_SERIES
from ..operators.sequence import idle_times, unchanged_runs
from ..session import materialize
from .runner import BatchOperator, drain_append, file_stream

# Reports can arrive more than a month late.
DEFAULT_LATENESS = "45 days"


def as_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone; the session zone must be UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def incremental(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform=lambda df: df) -> DataFrame:
    """Load files that were not loaded before. The checkpoint remembers them across calls and failures."""
    drain_append(transform(file_stream(spark, source, schema)), sink, checkpoint)
    return spark.read.parquet(sink)


def stream_hits(df: DataFrame, key: str, ts: str = "ts", period: str = "1 day", late: str = DEFAULT_LATENESS) -> DataFrame:
    """Hits per period and key as the log arrives; rows later than ``late`` are left out
    (``stream_all_hits`` counts them as corrections)."""
    return (
        df.withWatermark(ts, late)
        .groupBy(F.window(ts, period).alias("w"), key)
        .agg(F.count("*").alias("hits"))
        .select(F.col("w.start").alias("period_start"), key, "hits")
    )


def stream_state(df: DataFrame, keys: list[str], order: list[str], action: str) -> DataFrame:
    """Current state per key: the latest action."""
    return df.groupBy(*keys).agg(F.max_by(F.col(action), F.struct(*order)).alias("state"), F.count("*").alias("n_actions"))


def stream_once(df: DataFrame, key: str) -> DataFrame:
    """Each key once, however long ago it was first seen: every key is kept as state (on disk,
    see ``runner.disk_state``)."""
    return df.select(key).dropDuplicates([key])


HITS_OUT = "period_start timestamp, key string, hits bigint, late boolean"
HITS_STATE = "newest timestamp"


def stream_all_hits(df: DataFrame, key: str, ts: str = "ts", period: str = "1 day", late: str = DEFAULT_LATENESS) -> BatchOperator:
    """Hits per period and key of every row, however late, as rows that add up.

    A batch adds ``period_start, key, hits, late``. A period is closed once its end is ``late``
    before the newest row of the batches before; counts that come for a closed period are
    marked ``late``: corrections to what was reported already. No count is kept as state.
    """

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        newest = state.agg(F.max("newest")).first()[0]
        closed = F.lit(False) if newest is None else F.col("w.end") <= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        rows = batch.where(F.col(ts).isNotNull()).groupBy(F.window(ts, period).alias("w"), F.col(key).cast("string").alias("key")).agg(F.count("*").alias("hits"))
        seen = batch.agg(F.max(ts).cast("timestamp").alias("newest"))
        return rows.select(F.col("w.start").alias("period_start"), "key", "hits", closed.alias("late")), seen.unionByName(state).agg(F.max("newest").alias("newest"))

    return BatchOperator(df, step, HITS_OUT, HITS_STATE)


def reported_hits(counts: DataFrame) -> DataFrame:
    """Hits of each period as they were when it closed (so far, for open periods)."""
    return counts.where(~F.col("late")).groupBy("period_start", "key").agg(F.sum("hits").alias("hits"))


def late_hits(counts: DataFrame) -> DataFrame:
    """The corrections: hits that came after their period closed."""
    return counts.where("late").groupBy("period_start", "key").agg(F.sum("hits").alias("hits"))


def corrected_hits(counts: DataFrame) -> DataFrame:
    """Both merged: equal to the count over the whole log."""
    return counts.groupBy("period_start", "key").agg(F.sum("hits").alias("hits"))


STABLE_OUT = "series bigint, stable_ts timestamp, stable_value bigint"
STABLE_STATE = "series bigint, ts timestamp, doc_count bigint, run bigint, done boolean"


def stream_stable(df: DataFrame, n: int, long_series: int = LONG_SERIES) -> BatchOperator:
    """First sample per series that repeats its predecessor for the ``n``-th time.

    Samples ``series, ts, doc_count`` must not arrive later than the batch of their successors;
    inside a batch any order will do. Each batch is the batch operator on its samples, begun by
    one row for each series that stands for the samples before.
    """

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        keep = batch.where(F.col("doc_count").isNotNull() & (F.col("doc_count") != 0)).select("series", "ts", "doc_count", F.lit(None).cast("bigint").alias("carried"))
        open_ = keyed_join(keep, state.where("done").select("series"), "series", "left_anti")
        seeds = state.where("not done").select("series", "ts", "doc_count", F.col("run").alias("carried"))
        runs = materialize(unchanged_runs(open_.unionByName(seeds), ["series"], "ts", "doc_count", long_series=long_series, carried="carried"))
        fresh = runs.where("carried is null")
        found = fresh.where(F.col("run") >= n).groupBy("series").agg(F.min_by(F.struct("ts", "doc_count"), "ts").alias("s"))
        found = found.select("series", F.col("s.ts").alias("stable_ts"), F.col("s.doc_count").alias("stable_value"))
        last = runs.groupBy("series").agg(F.max_by(F.struct("ts", "doc_count", "run"), F.struct("ts", F.col("carried").isNull())).alias("l"), F.bool_or(F.col("carried").isNull() & (F.col("run") >= n)).alias("done"))
        return found, last.select("series", "l.*", "done").unionByName(state.where("done"))

    return BatchOperator(df, step, STABLE_OUT, STABLE_STATE)


STALL_OUT = "series bigint, ts timestamp, idle_seconds bigint, kind string"
STALL_STATE = "series bigint, ts timestamp, doc_count bigint, last_increase timestamp, alarmed boolean"


def stream_stall(df: DataFrame, seconds: int, late: str = "0 seconds", long_series: int = LONG_SERIES) -> BatchOperator:
    """Alarms of series without an increase for more than ``seconds``.

    ``kind`` is ``sample`` for a sample that shows the stall and ``timeout`` for a series that
    fell silent: the newest sample of any series, less ``late``, is past the limit, and no
    alarm was raised since the last increase.
    """

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        samples = batch.select("series", "ts", "doc_count", F.lit(None).cast("timestamp").alias("carried"), F.lit(True).alias("fresh"), F.lit(False).alias("was"))
        seeds = state.select("series", "ts", "doc_count", F.col("last_increase").alias("carried"), F.lit(False).alias("fresh"), F.col("alarmed").alias("was"))
        rows = materialize(idle_times(samples.unionByName(seeds), ["series"], "ts", "doc_count", long_series, carried="carried"))
        alarm = F.col("fresh") & (F.col("idle_seconds") > seconds)
        order = F.struct("ts", "fresh")
        per = rows.groupBy("series").agg(
            F.max("ts").alias("ts"),
            F.max_by("doc_count", F.when(F.col("doc_count").isNotNull(), order)).alias("doc_count"),
            F.max("last_increase").alias("last_increase"),
            F.max(F.when(alarm | F.col("was"), F.coalesce("last_increase", F.col("carried")))).alias("alarm_of"),
        )
        newest = rows.agg(F.max("ts")).first()[0]
        now = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        idle = F.timestamp_diff("SECOND", F.col("last_increase"), now)
        settled = F.coalesce(F.col("alarm_of") >= F.col("last_increase"), F.lit(False))
        silent = F.coalesce(~settled & (idle > seconds), F.lit(False))
        after = materialize(per.withColumns({"silent": silent, "idle": idle, "alarmed": settled | silent}))
        found = rows.where(alarm).select("series", "ts", "idle_seconds", F.lit("sample").alias("kind"))
        quiet = after.where("silent").select("series", now.alias("ts"), F.col("idle").alias("idle_seconds"), F.lit("timeout").alias("kind"))
        return found.unionByName(quiet), after.select("series", "ts", "doc_count", "last_increase", "alarmed")

    return BatchOperator(df, step, STALL_OUT, STALL_STATE)
