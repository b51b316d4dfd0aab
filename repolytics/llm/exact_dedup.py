"""Exact deduplication by progressive refinement.

Rows are grouped by byte length, the groups left over by length and a hash of a short prefix,
and what is left again by a hash of the whole content (SHA-256). Each level shuffles keys and
counts only, combined map-side, so a text with any number of copies costs one row per task.
Whether a row survives a level is known only after a join, so the content hash is taken in the
stage that reads the row: hashing where the text lies is cheaper than moving it. Only hashes
of surviving groups reach the last grouping.

Defined results: a null text equals the empty text; a null id is smaller than any id; of
equal rows with equal ids exactly one is kept; an empty table gives an empty result; columns of
any name may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

PREFIX_CHARS = 64
_ID, _LEN, _PRE, _FULL, _N = "__id", "__len", "__prefix", "__full", "__n"


def content(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def content_hash(text: str) -> Column:
    return F.unhex(F.sha2(content(text), 256))


def _levels(text: str) -> dict[str, Column]:
    t = content(text)
    return {_LEN: F.octet_length(t), _PRE: F.xxhash64(F.substring(t, 1, PREFIX_CHARS))}


def surviving_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(length, prefix hash)`` groups with more than one row."""
    level = _levels(text)
    lengths = docs.groupBy(level[_LEN].alias(_LEN)).agg(F.count("*").alias(_N)).where(F.col(_N) > 1).select(_LEN)
    keys = docs.select(level[_LEN].alias(_LEN), level[_PRE].alias(_PRE)).groupBy(_LEN, _PRE).agg(F.count("*").alias(_N))
    return keys.where(F.col(_N) > 1).join(lengths, _LEN, "left_semi").select(_LEN, _PRE)


def duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per (id, content): ``__id, __full, copies, keep_id, group_size``, one row for any number of equal rows."""
    slim = docs.select(F.col(f"`{id}`").alias(_ID), content_hash(text).alias(_FULL), *[c.alias(n) for n, c in _levels(text).items()])
    groups = written(surviving_groups(docs, text))
    alone = slim.join(groups, [_LEN, _PRE], "left_anti").select(_ID, _FULL, F.lit(1).cast("bigint").alias("copies"), F.col(_ID).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    full = [_LEN, _PRE, _FULL]
    open_rows = slim.join(groups, [_LEN, _PRE], "left_semi")
    # combined by (content, id) first: what meets afterwards is one row per id
    per_id = open_rows.groupBy(*full, _ID).agg(F.count("*").alias("copies"))
    per_text = open_rows.groupBy(*full).agg(F.max(_ID).alias("keep_id"), F.count("*").alias("group_size"))
    decided = per_id.join(per_text, full).select(_ID, _FULL, "copies", "keep_id", "group_size")
    return alone.unionByName(decided)


def mark_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``."""
    groups = duplicate_groups(docs, id, text)
    each = groups.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    kept = F.col(_ID).eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)
    return each.select(F.col(_ID).alias(id), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(_FULL)).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns: of equal texts the one with the largest id.

    Of rows that tie on the id as well, the one whose other columns are largest stays; those
    columns must then be orderable.
    """
    columns = docs.columns
    groups = duplicate_groups(docs, id, text)
    stays = F.col(_ID).eqNullSafe(F.col("keep_id"))
    marked = written(groups.where(~stays | (F.col("copies") > 1)).select(F.col(_ID).alias("__mid"), F.col(_FULL).alias("__mfull"), stays.alias("__stays")))
    keyed = docs.withColumn(_FULL, content_hash(text))
    on = F.col(f"`{id}`").eqNullSafe(F.col("__mid")) & (F.col(_FULL) == F.col("__mfull"))
    clear = keyed.join(marked, on, "left_anti").select(*[F.col(f"`{c}`") for c in columns])
    if marked.where("__stays").isEmpty():
        # no id holds the same text twice: whole rows are not shuffled a second time for ties
        return clear
    tied = keyed.join(marked.where("__stays"), on, "left_semi")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    one = tied.groupBy(F.col(f"`{id}`").alias("__k"), _FULL).agg(F.max(row).alias("__r"))
    return clear.unionByName(one.select(*[F.col(f"__r.c{i}").alias(c) for i, c in enumerate(columns)]))
