"""Sorts with explicit positions, ranked lists, tails and version order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Total order with dense positions from 1, computed by all tasks of a range-partitioned sort.

    The sorted rows are fixed in the reliable checkpoint together with their partition, because
    both the rows and the partition sizes must come from the same sampled ranges. The only
    unpartitioned window then runs over one row per sort partition.
    """
    part, seq = "__part", "__seq"
    ranked = df.orderBy(*order).withColumns({part: F.spark_partition_id(), seq: F.monotonically_increasing_id()})
    fixed = materialize(ranked)
    sizes = fixed.groupBy(part).agg(F.count("*").alias("__n"), F.min(seq).alias("__first"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    return (
        # one row per sort partition: bounded by the number of shuffle partitions
        fixed.join(F.broadcast(offsets), part)
        .withColumn(name, F.col("__offset") + F.col(seq) - F.col("__first") + 1)
        .drop(part, seq, "__first", "__offset")
    )


def order_ci(df: DataFrame, col: str, *tie: str) -> DataFrame:
    """Sort by name without case; ``tie`` restores the input order of equal names."""
    return df.orderBy(F.lower(F.col(col)), *tie)


def positioned_ci(df: DataFrame, col: str, *tie: str) -> DataFrame:
    return with_position(df, F.lower(F.col(col)), *[F.col(t) for t in tie])


def rank_hits(hits: DataFrame, key: str, count: str = "hits", first: str = "first_seen") -> DataFrame:
    """Ranked list: most hits first, equal counts by first appearance, then by key."""
    return with_position(hits, F.col(count).desc(), F.col(first), F.col(key), name="rank")


def order_hidden(df: DataFrame, order: list[Column], out: list[str]) -> DataFrame:
    """Sort by columns that are not in the output; the position keeps the order visible."""
    return with_position(df, *order).select("position", *out)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Last ``n`` rows of a log."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def tail_then(df: DataFrame, n: int, cond: Column, *order: str) -> DataFrame:
    """Matches among the last ``n`` rows."""
    return tail(df, n, *order).where(cond)


def then_tail(df: DataFrame, cond: Column, n: int, *order: str) -> DataFrame:
    """Last ``n`` rows among the matches."""
    return tail(df.where(cond), n, *order)
