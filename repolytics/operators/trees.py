"""Walking parent/child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def children(df: DataFrame, parent: str, value) -> DataFrame:
    return df.where(F.col(parent) == value)


def expand_tree(edges: DataFrame, root: str, sep: str = "/") -> DataFrame:
    """All nodes below ``root`` with depth and full path. ``edges`` has ``parent, child, name``.

    One join per level. Each level is written to the reliable checkpoint, so a level is
    computed once and the plan stays flat however deep the tree is. The edges are written once
    as well. A cycle is an error: every row carries the nodes above it.
    """
    edges = materialize(edges.select("parent", "child", "name"))
    level = edges.where(F.col("parent") == root).select(
        F.col("child").alias("node"), F.lit(1).alias("depth"), F.col("name").alias("path"), F.array("parent", "child").alias("above")
    )
    levels = []
    while True:
        level = materialize(level)
        if level.isEmpty():
            break
        if not level.where(F.size(F.array_distinct("above")) < F.size("above")).isEmpty():
            raise ValueError("the tree has a cycle")
        levels.append(level.drop("above"))
        level = level.join(edges, F.col("node") == F.col("parent")).select(
            F.col("child").alias("node"), F.col("depth") + 1, F.concat_ws(sep, "path", "name").alias("path"), F.array_append("above", F.col("child"))
        ).toDF("node", "depth", "path", "above")
    return reduce(DataFrame.unionByName, levels) if levels else level.drop("above")
