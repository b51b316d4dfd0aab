"""Texts of any length as ordered fragments.

A document with very many entries must not become one row, one list or one task. It is kept
as rows ``keys, place, fragment``: place 0 opens it, the entries follow with their separators,
the last place closes it. The document is its fragments, one after the other in the order of their
places; a file of fragments in that order (``sources.writers.write_documents``) is the
document as a stream.

Places come from the ordered series of all rows, so a document that owns a third of the table is
numbered by many tasks.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import LONG_SERIES, OrderedSeries, Running


def _placed(series: OrderedSeries, framed: bool) -> DataFrame:
    """Rows of a series with their ``place``; those without a frame are left out if ``framed``."""
    one = F.lit(1).cast("bigint")
    placed = series.add({"__n": Running("sum", one), "__framed": Running("max", F.col("__kind") == 0)}).result()
    if framed:
        placed = placed.where("__framed")
    return placed.withColumn("place", F.col("__n") - 1)


def _separated(text: Column | str, separator: str, framed: bool) -> Column:
    follows = (F.col("__kind") == 1) & (F.col("place") > (1 if framed else 0))
    return F.concat(F.when(follows, F.lit(separator)).otherwise(F.lit("")), text)


def fragments(
    entries: DataFrame, keys: list[str], order: list[str], text: Column, frames: DataFrame | None = None, separator: str = ",", long_series: int = LONG_SERIES
) -> DataFrame:
    """``keys, place, fragment`` of the entries' texts, separated, in the order of ``order`` and then of the texts.

    ``frames`` has ``keys, head, tail``, one row for each document: the text around its entries. A
    document without entries is head and tail, entries without a frame are left out. Without
    frames, places start at 0 with the first entry.
    """
    sort = [f"__o{i}" for i in range(len(order))]
    rows = entries.select(*keys, F.lit(1).alias("__kind"), *[F.col(f"`{c}`").alias(s) for c, s in zip(order, sort)], text.alias("__text"))
    framed = frames is not None
    if framed:
        ends = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("head").alias("t")), F.struct(F.lit(2).alias("k"), F.col("tail").alias("t")))).alias("__e")
        ends = frames.select(*keys, ends).select(*keys, F.col("__e.k").alias("__kind"), F.col("__e.t").alias("__text"))
        rows = rows.unionByName(ends, allowMissingColumns=True)
    placed = _placed(OrderedSeries.of(rows, keys, ["__kind", *sort, "__text"], long_series), framed)
    return placed.select(*keys, "place", _separated("__text", separator, framed).alias("fragment"))


def _body(text: Column, head: Column, tail: Column) -> Column:
    return F.when(F.col("__kind") == 0, head).when(F.col("__kind") == 2, tail).otherwise(text)


def placed_rows(
    entries: DataFrame, keys: list[str], order: list[Column], frames: DataFrame, head: Column, tail: Column, long_series: int = LONG_SERIES
) -> DataFrame:
    """The rows that ``fragments`` makes texts of, with their ``place`` but without the text: ``late_text`` builds
    it where it is wanted, so that only the columns of both tables are dealt out, not texts many times as long.

    The tables share no columns but ``keys``. ``order``, of columns of ``entries``, sorts a document's entries; those
    that tie must be alike. ``head`` and ``tail``, of columns of ``frames``, sort the frames of documents that have the same key.
    """
    ends = frames.withColumn("__kind", F.explode(F.array(F.lit(0), F.lit(2))))
    rows = entries.withColumn("__kind", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    # the columns of the other table are null; what is made of them need not be
    sort = {f"__o{i}": F.when(F.col("__kind") == 1, c) for i, c in enumerate(order)}
    sort["__end"] = F.when(F.col("__kind") != 1, _body(F.lit(None), head, tail))
    series = OrderedSeries.of(rows, keys, ["__kind", *sort.values()], long_series)
    # what rows are sorted by is built where they lie already, once
    series = replace(series, short=series.short.repartition(*keys)).map(lambda df: df.withColumns(sort))
    return _placed(replace(series, order=["__kind", *sort]), True).drop("__n", "__framed", *sort)


def late_text(text: Column, head: Column, tail: Column, separator: str = ",") -> Column:
    """The fragment of a row of ``placed_rows``."""
    return _separated(_body(text, head, tail), separator, True)


def whole_texts(rows: DataFrame, keys: list[str], name: str = "document") -> DataFrame:
    """Fragments as one text per key, for documents that are wanted as a value. A text is
    gathered in one row, so it must fit one; ``write_documents`` has no such bound."""
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "fragment"))).alias("__l"))
    return parts.select(*keys, F.array_join("__l.fragment", "").alias(name))
