"""Order-sensitive operators: repeats, context, stability, stalls, flags, gaps, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_index
from ..functions.text import lines_of
from .joins import keyed_join
from .ordered import LONG_SERIES, OrderedSeries, Running


def later_duplicates(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every occurrence of a key but the first.

    The first occurrence is an aggregate combined map-side, and it is removed by its own
    (unique) position, so a key that fills a third of the table is spread like any other.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__f")).select("__f.*")
    return df.where(F.col(key).isNotNull()).join(firsts, order, "left_anti")


def context_lines(lines: DataFrame, file: str, line_no: str, hit: Column, before: int = 2, after: int = 2) -> DataFrame:
    """Matching lines with their neighbours, each line once.

    Matches are widened to line numbers and joined back on (file, line), so even one huge
    file is spread over all tasks.
    """
    wanted = (
        lines.where(hit)
        .select(file, F.explode(F.sequence(F.col(line_no) - before, F.col(line_no) + after)).alias(line_no))
        .distinct()
    )
    return lines.join(wanted, [file, line_no], "left_semi")


def context_of_text(text: Column, pattern: str, before: int = 2, after: int = 2) -> Column:
    """The same for a text held in one row: ``array<struct<line_no,line>>``, no shuffle at all."""

    def around(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
        hits = F.transform(F.filter(numbered, lambda s: s["line"].rlike(pattern)), lambda s: s["line_no"])
        wanted = F.array_distinct(F.flatten(F.transform(hits, lambda n: F.sequence(F.greatest(n - before, F.lit(1)), n + after))))
        wanted = F.array_sort(F.filter(wanted, lambda n: n <= F.size(lines)))
        return F.transform(wanted, lambda n: F.struct(n.alias("line_no"), F.get(lines, n - 1).alias("line")))

    # as the variable of an outer function the text is split once, not once for each hit
    return F.transform(F.array(lines_of(text)), around)[0]


def unchanged_runs(samples: DataFrame, keys: list[str], ts: str, value: str, reset: str = "change", skip_empty: bool = True, long_series: int = LONG_SERIES, carried: str | None = None) -> DataFrame:
    """Adds ``run``: how many samples in a row repeated their predecessor, and ``changes`` so far.

    ``reset="change"`` starts over at any change, ``reset="increase"`` only when the count grew.
    Missing and zero samples are no samples when ``skip_empty``. ``carried`` names a column that
    is null but on a first row that stands for the samples before: it holds their ``run``.
    """
    v, prev = F.col(value), F.col("__prev")
    rows = samples.where(v.isNotNull() & (v != 0)) if skip_empty else samples
    flags = {
        "__same": F.coalesce(*([] if carried is None else [F.col(carried)]), (v == prev).cast("bigint"), F.lit(0)),
        "__changed": F.coalesce((v != prev).cast("bigint"), F.lit(0)),
        "__start": (v != prev) if reset == "change" else (v > prev),
    }
    series = (
        OrderedSeries.of(rows, keys, [ts], long_series)
        .add({"__prev": Running("last", v, before=True)})
        .map(lambda df: df.withColumns(flags))
        .add({"__total": Running("sum", F.col("__same")), "changes": Running("sum", F.col("__changed"))})
        .add({"__base": Running("max", F.when(F.col("__start"), F.col("__total")))})
    )
    run = F.col("__total") - F.coalesce(F.col("__base"), F.lit(0))
    return series.result().withColumn("run", run).drop("__prev", "__same", "__changed", "__start", "__total", "__base")


def stable_at(
    samples: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    n: int,
    target: int | None = None,
    reset: str = "change",
    skip_empty: bool = True,
    after_change: bool = False,
    long_series: int = LONG_SERIES,
) -> DataFrame:
    """First sample per series that repeats its predecessor for the ``n``-th time, or reaches the target."""
    runs = unchanged_runs(samples, keys, ts, value, reset, skip_empty, long_series)
    done = F.col("run") >= n
    if after_change:
        done = done & (F.col("changes") > 0)
    if target is not None:
        done = done | (F.col(value) >= target)
    return (
        runs.where(done)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(F.col(ts), F.col(value)), F.col(ts)).alias("__s"))
        .select(*keys, F.col(f"__s.{ts}").alias("stable_ts"), F.col(f"__s.{value}").alias("stable_value"))
    )


def idle_times(samples: DataFrame, keys: list[str], ts: str, value: str, long_series: int = LONG_SERIES, carried: str | None = None) -> DataFrame:
    """Adds ``last_increase`` and ``idle_seconds``, the time since. ``carried`` names a column that
    is null but on a first row that stands for the samples before: it holds their last increase."""
    grew = F.when(F.col(value) > F.col("__prev"), F.col(ts))
    rows = (
        OrderedSeries.of(samples, keys, [ts], long_series)
        .add({"__prev": Running("last", F.col(value), before=True)})
        .add({"last_increase": Running("max", grew if carried is None else F.coalesce(F.col(carried), grew))})
        .result()
    )
    return rows.withColumn("idle_seconds", F.timestamp_diff("SECOND", F.col("last_increase"), F.col(ts))).drop("__prev")


def stalls(samples: DataFrame, keys: list[str], ts: str, value: str, seconds: int, long_series: int = LONG_SERIES) -> DataFrame:
    """Samples taken more than ``seconds`` after the last increase of their series."""
    return idle_times(samples, keys, ts, value, long_series).where(F.col("idle_seconds") > seconds)


def after_flag(lines: DataFrame, keys: list[str], pos: str, flag: Column, target: Column) -> DataFrame:
    """Target lines that come after a flag line of the same run.

    An earlier flag exists exactly when the first one is earlier, so a map-side combined
    minimum replaces an ordered pass.
    """
    first = lines.where(flag).groupBy(*keys).agg(F.min(pos).alias("__flag_pos"))
    return keyed_join(lines.where(target), first, keys).where(F.col(pos) > F.col("__flag_pos")).drop("__flag_pos")


def contiguous_months(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Months from the first one of each key up to the first gap.

    The months of a key are collected as a set, which cannot outgrow the calendar.
    """
    months = F.array_sort(F.collect_set(month_index(day)))
    per_key = df.groupBy(*keys).agg(months.alias("__m")).withColumn(
        # a month belongs to the unbroken prefix when it is as far from the start as its position
        "__prefix", F.size(F.filter(F.col("__m"), lambda x, i: x - F.get(F.col("__m"), F.lit(0)) == i))
    )
    return per_key.select(
        *keys,
        _month_text(F.get("__m", F.lit(0))).alias("first_month"),
        _month_text(F.get("__m", F.col("__prefix") - 1)).alias("last_month"),
        F.col("__prefix").cast("bigint").alias("months"),
        (F.size("__m") > F.col("__prefix")).alias("has_gap"),
    )


def _month_text(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.call_function("div", index, F.lit(12)), index % 12 + 1)


def current_state(events: DataFrame, keys: list[str], order: list[str], action: str) -> DataFrame:
    """Latest action per key; the last one in the log wins."""
    return events.groupBy(*keys).agg(
        F.max_by(F.col(action), F.struct(*order)).alias("state"), F.count("*").alias("n_actions")
    )
