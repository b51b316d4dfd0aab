"""Join operators.

But for ``with_children``, which names the side that is held, no size hint is given: which side
is broadcast is left to the optimizer and to adaptive execution, which decide on measured sizes
and fall back to a (skew-split) sort-merge join. Sides used only for membership are reduced to distinct keys first, so a hot key never
multiplies and only ever sits on the side that adaptive execution can split (``keyed_join``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import option_key, option_text
from .ordered import LONG_SERIES, OrderedSeries, Running


def distinct_keys(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.select(*cols).distinct()


def keyed_join(rows: DataFrame, side: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join rows, whose keys may be hot, to a side with each key at most once.

    Adaptive execution splits a hot key only where both inputs are shuffled for the join. A
    side that was just grouped by the key would keep that partitioning and prevent it, so keys
    are compared null-safe: both inputs are then shuffled anew (the side is one slim row per
    key). Null keys of the side are dropped, so null still matches nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    others = [c for c in side.columns if c not in keys]
    known = side.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    renamed = known.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *others)
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    joined = rows.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__key_{k}" for k in keys])


def related_distinct(left: DataFrame, link: DataFrame, target: DataFrame, left_on: tuple[str, str], link_on: tuple[str, str], out: list[str]) -> DataFrame:
    """Distinct target columns reachable from ``left`` through ``link``.

    ``left_on`` and ``link_on`` are (from, to) column pairs. Only existence counts, so both
    steps are semi joins and no row is ever multiplied.
    """
    reached = keyed_join(link, distinct_keys(left, F.col(left_on[0]).alias(left_on[1])), left_on[1], "left_semi")
    ids = distinct_keys(reached, F.col(link_on[0]).alias(link_on[1]))
    return target.join(ids, link_on[1], "left_semi").select(*out).distinct()


def with_parent(child: DataFrame, parent: DataFrame, on: str | list[str]) -> DataFrame:
    """Children with their parent's columns; children without a parent stay."""
    return keyed_join(child, parent, on, "left")


def with_children(parent: DataFrame, child: DataFrame, on: str) -> DataFrame:
    """Parents with each of their children; parents without any stay with nulls.

    Split into matched and childless parents: an outer join could not spread one parent's
    many children over tasks, an inner join can. The larger side of each is streamed: sorted
    keys shrink so much in a shuffle that few tasks, each with very many rows to sort, result.
    """
    matched = child.join(parent.hint("shuffle_hash"), on, "inner").select(on, *[c for c in parent.columns if c != on], *[c for c in child.columns if c != on])
    childless = parent.join(distinct_keys(child, on).hint("shuffle_hash"), on, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def coverage_matrix(parents: DataFrame, blocks: DataFrame, enabled: DataFrame, group: str, parent: str, block: str) -> DataFrame:
    """Every parent of a template against every block of the same template: ENABLED or MISSING.

    Parents and blocks meet on their template, so templates are handled side by side.
    """
    pairs = enabled.select(parent, block).distinct().withColumn("__enabled", F.lit(True))
    return (
        parents.join(blocks.select(group, block).distinct(), group)
        .join(pairs, [parent, block], "left")
        .withColumn("status", F.when(F.col("__enabled"), "ENABLED").otherwise("MISSING"))
        .drop("__enabled")
    )


def effective_levels(parents: DataFrame, fields: DataFrame, overrides: DataFrame, group: str, parent: str, field: str) -> DataFrame:
    """Input level of every template field in every parent; without an override it is included and optional."""
    return (
        parents.join(fields, group)
        .join(overrides.select(parent, field, "include", "required"), [parent, field], "left")
        .withColumns(
            {
                "include": F.coalesce("include", F.lit(True)),
                "required": F.coalesce("required", F.lit(False)),
            }
        )
    )


def exclude_denied(df: DataFrame, deny: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of sources that are not denied, and the number of dropped rows (one row, ``dropped``)."""
    deny = distinct_keys(deny, key)
    kept = keyed_join(df, deny, key, "left_anti")
    return kept, keyed_join(df, deny, key, "left_semi").agg(F.count("*").alias("dropped"))


def pending(items: DataFrame, manifest: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Items still to be fetched: those not both recorded and present."""
    done = distinct_keys(manifest, key).join(distinct_keys(present, key), key, "left_semi")
    return keyed_join(items, done, key, "left_anti")


def options_of(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """Cleaned options of a listing with their comparison key, and the columns to keep."""
    cleaned = df.select(*keep, option_text(col).alias("option")).where(F.col("option").isNotNull())
    return cleaned.withColumn("key", option_key("option"))


def missing_options(a: DataFrame, b: DataFrame, exclude: str | None = None) -> DataFrame:
    """Options of ``a`` whose key does not occur in ``b``; an excluded family is left out."""
    wanted = a if exclude is None else a.where(~F.col("key").rlike(exclude))
    return keyed_join(wanted, distinct_keys(b, "key"), "key", "left_anti")


def retype(files: DataFrame, names: DataFrame, file_id: str, type_col: str, label: str, when_type: str, pattern: str, new: str) -> DataFrame:
    """Give files of one type a new type when any of their names matches a LIKE pattern."""
    hit = distinct_keys(names.where(F.col(label).like(pattern)), file_id).withColumn("__hit", F.lit(True))
    change = (F.col(type_col) == when_type) & F.col("__hit")
    return files.join(hit, file_id, "left").withColumn(type_col, F.when(change, F.lit(new)).otherwise(F.col(type_col))).drop("__hit")


def rekey(df: DataFrame, type_col: str, old, new, cond: Column) -> DataFrame:
    """Move matching rows from one type id to another; ``moved`` tells which."""
    moved = F.coalesce((F.col(type_col) == old) & cond, F.lit(False))
    return df.withColumn("moved", moved).withColumn(type_col, F.when(F.col("moved"), new).otherwise(F.col(type_col)))


def as_of(df: DataFrame, ts: str, day: Column | str, *tie: str) -> DataFrame:
    """The latest snapshot strictly before the day after ``day``; no rows when there is none."""
    limit = F.date_add(F.to_date(F.lit(day)) if isinstance(day, str) else day, 1)
    latest = df.where(F.col(ts) < limit.cast(df.schema[ts].dataType)).agg(
        F.max_by(F.struct(*df.columns), F.struct(ts, *tie)).alias("__s")
    )
    return latest.where(F.col("__s").isNotNull()).select("__s.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, right_tie: list[str], strict: bool = False, long_series: int = LONG_SERIES) -> DataFrame:
    """Each left row with the latest right row of its key at (or, when strict, before) its time.

    Both sides are put in one ordered series and the latest right row is carried forward, so
    no pair but the wanted one is ever formed. A null key matches nothing.
    """
    right = right.where(F.col(key).isNotNull())
    values = [c for c in right.columns if c != key]
    side_right = 1 if strict else 0
    lrows = left.select(key, F.col(lt).alias("__t"), F.lit(1 - side_right).alias("__side"), F.struct(*left.columns).alias("__l"))
    rrows = right.select(
        key,
        F.col(rt).alias("__t"),
        F.lit(side_right).alias("__side"),
        F.struct(*values).alias("__r"),
        *[F.col(c).alias(f"__tie_{c}") for c in right_tie],
    )
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    order = ["__t", "__side", *[f"__tie_{c}" for c in right_tie]]
    series = OrderedSeries.of(both, [key], order, long_series).add({"__latest": Running("last", F.col("__r"))})
    return series.result().where(F.col("__l").isNotNull()).select("__l.*", *[F.col(f"__latest.{c}").alias(c) for c in values])


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Presence of every key of two systems: ``both``, ``a_only`` or ``b_only``, with row counts.

    Both sides are counted per key first, so the outer join meets each key once.
    """
    left = a.groupBy(key).agg(F.count("*").alias("n_a"))
    right = b.groupBy(key).agg(F.count("*").alias("n_b"))
    status = F.when(F.col("n_b").isNull(), "a_only").when(F.col("n_a").isNull(), "b_only").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("status", status).fillna(0, ["n_a", "n_b"])


# Fixed value: how an expected checksum that nobody filled in yet starts.
CHECKSUM_PLACEHOLDER = "REPLACE_WITH_OFFICIAL_"


def verify_checksums(files: DataFrame, expected: DataFrame, key: str, actual: str, wanted: str) -> DataFrame:
    """``match``, ``mismatch``, ``unverified`` (placeholder), or ``absent`` (no expectation)."""
    status = (
        F.when(F.col(wanted).isNull(), "absent")
        .when(F.col(wanted).startswith(CHECKSUM_PLACEHOLDER), "unverified")
        .when(F.col(wanted) == F.col(actual), "match")
        .otherwise("mismatch")
    )
    return files.join(expected.select(key, wanted), key, "left").withColumn("status", status)


def missing_required(df: DataFrame, name: str, required: list[str], group: str, groups: DataFrame | None = None) -> DataFrame:
    """Required names that a group lacks, one row each.

    Present names are collected as a set that can hold no more than the required list. With a
    table of ``groups`` a group without any row lacks everything.
    """
    present = F.collect_set(F.when(F.col(name).isin(required), F.col(name)))
    wanted = F.array(*[F.lit(r) for r in required])
    found = df.groupBy(group).agg(present.alias("__p"))
    if groups is not None:
        found = groups.select(group).distinct().join(found, group, "left")
    lacking = F.array_except(wanted, F.coalesce("__p", F.array().cast("array<string>")))
    return found.select(group, F.explode(lacking).alias(name))


def has_all_required(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """One row: is every required name present anywhere?"""
    n = F.count_distinct(F.when(F.col(name).isin(required), F.col(name)))
    return df.agg((n == len(set(required))).alias("complete"))


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference: rows with the side that has more of them and how many more.

    Signed counts are summed in one pass; equal tables give no rows.
    """
    cols = a.columns
    signed = a.withColumn("__n", F.lit(1)).unionByName(b.select(*cols).withColumn("__n", F.lit(-1)))
    counted = signed.groupBy(*cols).agg(F.sum("__n").alias("__n")).where(F.col("__n") != 0)
    return counted.select(
        *cols, F.when(F.col("__n") > 0, "old").otherwise("new").alias("side"), F.abs("__n").alias("copies")
    )


def apply_changes(df: DataFrame, name: str, value: str, upserts: DataFrame, deletes: list[str] = (), delete_like: list[str] = ()) -> DataFrame:
    """Update or insert the given pairs; blank values and listed or LIKE-matched names are deleted."""
    kept = keyed_join(df, distinct_keys(upserts, name), name, "left_anti").select(name, value)
    new = upserts.select(name, value).where(F.col(value).isNotNull() & (F.col(value) != ""))
    gone = F.col(name).isin(list(deletes)) if deletes else F.lit(False)
    for pattern in delete_like:
        gone = gone | F.col(name).like(pattern)
    return kept.where(~F.coalesce(gone, F.lit(False))).unionByName(new)
