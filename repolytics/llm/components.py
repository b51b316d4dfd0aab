"""Connected components of an edge table by alternating large and small stars.

Each round joins the edges with the least neighbour of each node; nothing is collected but one
count, and lineage is cut by the reliable checkpoint. The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    side = both.where("v > u") if large else both.where("v < u").unionByName(both.select("u", F.col("u").alias("v")).distinct())
    linked = side.join(least, "u").where("v != m")
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest reachable node) of every node with an edge to another."""
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    while True:
        after = written(_star(_star(now, True), False))
        # settled when every node points to one smaller node that itself points nowhere
        loose = after.select(F.col("a").alias("n")).join(after.select(F.col("b").alias("n")).distinct(), "n", "left_semi")
        many = after.groupBy("a").count().where("count > 1").select(F.col("a").alias("n"))
        release(now)
        now = after
        if loose.unionByName(many).isEmpty():
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
