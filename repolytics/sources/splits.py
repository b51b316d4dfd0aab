"""Order across the splits of large text files.

Spark cuts a file into *blocks* that different tasks read; a task knows where its block starts
but not how many lines lie before it, nor whether the block starts inside a quoted value. Both
follow from one small row for each block: its lines and its odd lines (lines with an odd number of
quotes). Prefix sums over the blocks of a file give every block what it needs, so no task reads more
than a block, and lines are not sorted.

A line's place within its block comes from the order in which the block's task reads it; blocks and
lines belong to one query and are read under the same settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Blocks are sent to all tasks up to this many (some 100 bytes each), and joined beyond.
MOST_BLOCKS = 50_000


def split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, __block, __at, line``: ``__at`` grows by one from line to line of a block."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("line"),
    )


def block_table(rows: DataFrame, **measures: Column) -> DataFrame:
    """One row for each block: its first ``__at``, its number of lines, ``measures``, and
    ``lines_before``, the lines of the file before it."""
    blocks = rows.groupBy("path", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__lines"), *[c.alias(n) for n, c in measures.items()])
    return blocks.withColumn("lines_before", sum_before("__lines"))


def _earlier():
    return Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def sum_before(column: str) -> Column:
    """Sum of a measure over the earlier blocks of the file. A file has as many blocks as splits."""
    return F.coalesce(F.sum(column).over(_earlier()), F.lit(0))


def with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with their block's row, without moving the lines if there are few blocks."""
    files = rows.inputFiles()
    few = len(files) <= MOST_BLOCKS and len(files) + rows.rdd.getNumPartitions() <= MOST_BLOCKS
    return rows.join(F.broadcast(blocks) if few else blocks, ["path", "__block"])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, line_no, line`` of all files; numbers start at 1 in every file."""
    rows = split_lines(spark, path)
    placed = with_blocks(rows, block_table(rows))
    return placed.select("path", (F.col("lines_before") + F.col("__at") - F.col("__first") + 1).alias("line_no"), "line")


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, record``: lines, joined where a quoted value holds line breaks.

    Quotes are doubled inside quoted values, hence a line ends inside a value exactly when the
    number of quotes up to it is odd. ``line_no`` is the record's first line. Blocks that meet no odd line stay
    where they are read; lines of the others are ordered within their block and joined by
    record. A file whose last value is never closed is an error (it would swallow the rest).
    """
    rows = split_lines(spark, path).withColumn("__odd", F.length(F.regexp_replace("line", '[^"]', "")) % 2 == 1)
    blocks = block_table(rows, odd=F.count_if("__odd"), last=F.max(F.when(F.col("__odd"), F.col("__at"))))
    # the last odd line of a block that ends inside a value is the one that opened it
    opened = F.col("lines_before") + F.col("last") - F.col("__first") + 1
    blocks = blocks.withColumns({"odd_before": sum_before("odd"), "opener": F.last(opened, ignorenulls=True).over(_earlier())})
    ends = Window.partitionBy("path").orderBy(F.col("__block").desc())
    open_end = (F.row_number().over(ends) == 1) & ((F.col("odd_before") + F.col("odd")) % 2 == 1)
    blocks = blocks.withColumn("__open", open_end)
    placed = with_blocks(rows, blocks).withColumn("line_no", F.col("lines_before") + F.col("__at") - F.col("__first") + 1)
    failure = F.raise_error(F.concat(F.lit("quote without end in "), F.col("path"))).cast("string")
    placed = placed.withColumn("line", F.when(F.col("__open"), failure).otherwise(F.col("line")))
    # outside values, every line of a block without odd lines is a record
    plain = (F.col("odd") == 0) & (F.col("odd_before") % 2 == 0)
    single = placed.where(plain).select("path", "line_no", F.col("line").alias("record"))
    within = Window.partitionBy("path", "__block").orderBy("line_no")
    before = F.count_if("__odd").over(within.rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.col("odd_before") + F.coalesce(before, F.lit(0))) % 2 == 1
    states = placed.where(~plain).withColumn("__starts", F.when(~inside, F.col("line_no")))
    start = F.last("__starts", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = states.select("path", F.coalesce(start, F.col("opener")).alias("start"), F.struct("line_no", "line").alias("part"))
    joined = parts.groupBy("path", "start").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return single.unionByName(joined.select("path", F.col("start").alias("line_no"), F.array_join("parts.line", "\n").alias("record")))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered comma-separated files whose quoted values may hold quotes and line breaks.

    The first record of every file is its header; empty lines are left out.
    """
    bare = F.regexp_replace("record", "\r$", "")
    records = quoted_records(spark, path).where("line_no > 1").select(bare.alias("record")).where("record != ''")
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
