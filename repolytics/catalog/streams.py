"""Registered queries: streams drained to parquet, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.shapes import daily_counts, state_events
from ..streaming import operators as S
from ..streaming.runner import drain_append, file_stream, run_append, run_updates
from .ordered import STABLE_SQL, STALL_SQL, STATE_SQL
from .registry import query


def event_stream(t):
    # a pattern, because a table may be one file or a folder of part files
    return file_stream(t.spark, f"{t.folder}/events.parque[t]", t.events.schema)


def drained_samples(t, name, operator):
    """Daily samples that arrive in two halves; the second run continues from the state of the first."""
    path, sink = scratch_path(t.spark, f"{name}-in"), scratch_path(t.spark, name)
    samples = S.as_event_time(daily_counts(t.events))
    middle = F.lit("2024-01-15").cast("timestamp")
    for half in (F.col("ts") < middle, F.col("ts") >= middle):
        samples.where(half).write.mode("append").parquet(path)
        drain_append(operator(file_stream(t.spark, path, samples.schema)), sink, f"{sink}-state")
    return t.spark.read.parquet(sink)


@query("stm_01_incremental", "SELECT event_id, user_id, event_type FROM events")
def stm_01(t):
    source, sink = scratch_path(t.spark, "incoming"), scratch_path(t.spark, "loaded")
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    rows.where(F.col("ts") < middle).write.mode("append").parquet(source)
    S.incremental(t.spark, source, rows.schema, sink, f"{sink}-state")
    rows.where(F.col("ts") >= middle).write.mode("append").parquet(source)
    # the second call reads the new files only: nothing is loaded twice
    return S.incremental(t.spark, source, rows.schema, sink, f"{sink}-state").drop("ts")


@query("stm_02_stable", STABLE_SQL)
def stm_02(t):
    found = drained_samples(t, "stable", lambda samples: S.stream_stable(samples, 2))
    return found.select("series", F.date_format("stable_ts", "yyyy-MM-dd").alias("stable_day"), "stable_value")


@query("stm_03_stall", STALL_SQL)
def stm_03(t):
    found = drained_samples(t, "stall", lambda samples: S.stream_stall(samples, 172800)).where("kind = 'sample'")
    return found.select("series", F.date_format("ts", "yyyy-MM-dd").alias("day"), "idle_seconds")


@query("stm_04_state", STATE_SQL)
def stm_04(t):
    return run_updates(S.stream_state(state_events(event_stream(t)), ["key", "type"], ["ts", "event_id"], "action"), "state", ["key", "type"])


@query("stm_05_once", "SELECT DISTINCT user_id FROM events")
def stm_05(t):
    return run_append(S.stream_once(event_stream(t), "user_id"), "once")


@query(
    "stm_06_hits",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS hits FROM events GROUP BY ALL",
)
def stm_06(t):
    found = run_updates(S.stream_hits(S.as_event_time(event_stream(t)), "event_type"), "hits", ["period_start", "event_type"])
    return found.select(F.date_format("period_start", "yyyy-MM-dd").alias("day"), "event_type", "hits")


HITS_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS hits FROM events WHERE {} GROUP BY ALL"
# days of which a part arrives after the days behind them were counted and closed
LATE = "extract(day from ts) < 8 AND event_id % 3 = 0"


def counted_with_late_rows(t):
    """The log in two deliveries: the second brings old rows after all others, a week being the limit."""
    path, sink = scratch_path(t.spark, "late-in"), scratch_path(t.spark, "late")
    events = S.as_event_time(t.events.select("event_id", "event_type", "ts"))
    late = (F.dayofmonth("ts") < 8) & (F.col("event_id") % 3 == 0)
    for part in (~late, late):
        events.where(part).write.mode("append").parquet(path)
        drain_append(S.stream_all_hits(file_stream(t.spark, path, events.schema), "event_type", late="7 days"), sink, f"{sink}-state")
    return t.spark.read.parquet(sink)


def by_day(hits):
    return hits.select(F.date_format("period_start", "yyyy-MM-dd").alias("day"), F.col("key").alias("event_type"), "hits")


@query("stm_06_late_corrections", HITS_SQL.format(LATE + " AND date_trunc('day', ts) + INTERVAL 8 DAY <= (SELECT max(ts) FROM events)"))
def stm_06_late(t):
    return by_day(S.late_hits(counted_with_late_rows(t)))


@query("stm_06_corrected_hits", HITS_SQL.format("true"))
def stm_06_corrected(t):
    return by_day(S.corrected_hits(counted_with_late_rows(t)))
