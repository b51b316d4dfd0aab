"""Aggregations. All of them combine map-side; lists are replaced by rows or bounded sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import growth_percent, percent, share
from .filters import in_month, is_empty
from .joins import keyed_join
from .fragments import fragments
from .ordered import LONG_SERIES, number_rows


def count_in_month(df: DataFrame, ts: str, month: str) -> DataFrame:
    return in_month(df, ts, month).agg(F.count("*").alias("n"))


def monthly_counts(df: DataFrame, ts: str) -> DataFrame:
    """Entries of every month at once."""
    return df.groupBy(F.date_format(F.trunc(ts, "month"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def hits(df: DataFrame, key: str, ts: str | None = None, *pos: str) -> DataFrame:
    """Hits per identifier, with first appearance when a time column is given: the time, or the
    time and the log position when that is given as well."""
    first = F.struct(ts, *pos) if pos else F.col(ts) if ts else None
    extra = [] if first is None else [F.min(first).alias("first_seen")]
    return df.groupBy(key).agg(F.count("*").alias("hits"), *extra)


def details(df: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """Detail lines per identifier in log order: one row per line with its position.

    Rows rather than one list per identifier, because a single identifier may own a large
    part of the log.
    """
    return number_rows(df.select(key, *order, line.alias("line")), [key], order).select(key, "position", "line")


def count_by_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that satisfy each rule, from one scan."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])


def usage_totals(df: DataFrame, performance: str, metric: str) -> DataFrame:
    """Sum and number of the counts of one metric; the sum over nothing is null."""
    entries = df.select(F.explode(performance).alias("p")).select(F.explode("p.instance").alias("i"))
    return entries.where(F.col("i.metric-type") == metric).agg(
        F.sum("i.count").alias("total"), F.count("*").alias("n")
    )


def usage_summary(df: DataFrame, performance: str, metric: str, part: str | None = None) -> DataFrame:
    """Totals of one metric and the number of records with and without entries, from one pass.

    Each record is summed inside its row, so nothing is exploded below the record. ``part``
    names the part number of records kept in parts; such a record is counted once.
    """
    whole = F.lit(True) if part is None else F.col(part) == 0
    wanted = F.filter("instance", lambda x: x["metric-type"] == metric)
    rows = df.select(whole.alias("whole"), F.explode(performance).alias("p")).select("whole", F.col("p.instance").alias("instance")).select(
        "whole",
        "instance",
        F.coalesce(F.size(wanted), F.lit(0)).alias("n"),
        F.aggregate(wanted, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["count"], F.lit(0))).alias("total"),
    )
    return rows.agg(
        F.sum(F.when(F.col("n") > 0, F.col("total"))).alias("total"),
        F.sum("n").cast("bigint").alias("n"),
        F.count_if(F.col("whole") & (F.size("instance") > 0)).alias("with_entries"),
        F.count_if(F.col("whole") & is_empty("instance")).alias("without_entries"),
    )


def empty_split(df: DataFrame, array: Column | str) -> DataFrame:
    """Number of records with and without entries; a missing array counts as neither."""
    a = F.col(array) if isinstance(array, str) else array
    return df.agg(F.count_if(F.size(a) > 0).alias("with_entries"), F.count_if(is_empty(a)).alias("without_entries"))


def consistency(db: DataFrame, index: DataFrame, db_rules: dict[str, Column], index_rules: dict[str, Column]) -> DataFrame:
    """Database against index counts per kind (``dataset``, ``collection``) with a verdict.

    Both sides shrink to one row of counts, which are then stacked and summed.
    """
    kinds = list(db_rules)
    one = count_by_rules(db, db_rules).unionByName(
        count_by_rules(index, {k: index_rules[k] for k in kinds}).select(*[(-F.col(k)).alias(k) for k in kinds])
    )
    diff = one.agg(*[F.sum(k).alias(k) for k in kinds], *[F.sum(F.greatest(F.col(k), F.lit(0))).alias(f"db_{k}") for k in kinds])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("kind"), F.col(f"db_{k}").alias("db_count"), F.col(k).alias("discrepancy"))
                for k in kinds
            ]
        )
    )
    return diff.select(rows.alias("r")).select("r.*").withColumn("verdict", consistency_class(F.col("kind"), F.col("discrepancy")))


def consistency_class(kind: Column, discrepancy: Column) -> Column:
    """Datasets may be over-indexed (drafts); collections must agree, one missing is minor."""
    dataset = F.when(discrepancy < 0, "EXCELLENT").when(discrepancy > 0, "DISCREPANCY").otherwise("PERFECT")
    collection = F.when(discrepancy == 0, "PERFECT").when(discrepancy == 1, "MINOR").otherwise("DISCREPANCY")
    return F.when(kind == "dataset", dataset).otherwise(collection)


def duplicate_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of every key that occurs more than once, with the number of occurrences."""
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(key).isNotNull())
    return keyed_join(df.select(key, value), repeated, key)


def pattern_counts(df: DataFrame, line: Column | str, patterns: dict[str, str]) -> DataFrame:
    c = F.col(line) if isinstance(line, str) else line
    return count_by_rules(df, {name: c.rlike(p) for name, p in patterns.items()})


def field_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Records having a value, per field."""
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    return counts.unpivot([], cols, "field", "records")


def joined_names(df: DataFrame, keys: list[str], col: str, separator: str = ",", long_series: int = LONG_SERIES) -> DataFrame:
    """Distinct names per key in order, as the fragments of a separated list: ``keys, place, fragment``.

    ``whole_texts`` gives one text per key where the lists are short.
    """
    names = df.where(F.col(col).isNotNull()).select(*keys, col).distinct()
    return fragments(names, keys, [], F.col(col).cast("string"), separator=separator, long_series=long_series)


def compare_baseline(now: DataFrame, base: DataFrame, metric: str, value: str) -> DataFrame:
    """Current against baseline counts per metric: the floor test, the range and the progress.

    Fixed limits: metadata at 90 % of the base, index between 95 % and 120 %, warning below
    80 %, reindexing under way above 5 %. ``status`` tells whether a metric is on both sides
    or on one only; what needs both sides is then null.
    """
    n, b = F.col("now"), F.col("base")
    joined = now.select(metric, F.col(value).alias("now")).join(base.select(metric, F.col(value).alias("base")), metric, "full_outer")
    return joined.withColumns(
        {
            "status": F.when(b.isNull(), "now_only").when(n.isNull(), "base_only").otherwise("both"),
            "floor_ok": n >= share(b, 90),
            "range": F.when((n >= share(b, 95)) & (n <= share(b, 120)), "ok")
            .when(n < share(b, 80), "warning")
            .otherwise("info"),
            "started": n > share(b, 5),
            "percent_done": percent(n, b),
            "growth": growth_percent(n, b),
        }
    )


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key; ``order`` ends in a unique column."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def distribution_summary(files: DataFrame, encoding: str = "encodingFormat", size: str = "contentSize") -> DataFrame:
    """Files and bytes per encoding; sizes are text and unreadable ones count as no bytes."""
    return files.groupBy(encoding).agg(
        F.count("*").alias("files"), F.sum(F.coalesce(F.col(size).try_cast("bigint"), F.lit(0))).alias("bytes")
    )
