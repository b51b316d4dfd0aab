"""Running values over ordered series, with very long series split over many tasks.

A window over ``partitionBy(series)`` sorts each series in one task. That is the right plan
for series of ordinary length and needs a single shuffle. A series that holds a large part of
the table would choke its task, so series are counted first (keys only, combined map-side):

* no long series: one plain window;
* long series: their rows are range-sorted by (series, order) and fixed in the reliable
  checkpoint together with the number of their sort partition. Such a *chunk* is of even size
  whatever the skew. Each chunk gets one extra carry row holding the running values of the
  chunks before it, and a window over (series, chunk) continues from there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

# Rows of one series that a single task may sort.
LONG_SERIES = 2_000_000
# Long series are broadcast as a list of keys only up to this many.
MAX_BROADCAST_KEYS = 100_000

_CHUNK, _CARRY, _TIE = "__chunk", "__carry", "__tie"


@dataclass(frozen=True)
class Running:
    """One running value. ``kind`` is sum, min, max or last (latest non-null)."""

    kind: str
    value: Column
    before: bool = False
    """True looks at earlier rows only, False includes the current row."""


def _combine(kind: str, col: Column) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def _over(values: dict[str, Running], inputs: dict[str, Column], within) -> list[Column]:
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return [_combine(r.kind, inputs[n]).over(before if r.before else upto).alias(n) for n, r in values.items()]


def larger_than(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows. Only keys are shuffled, counted map-side first."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows)


@dataclass(frozen=True)
class OrderedSeries:
    """Rows in series. ``short`` holds series that fit a task, ``long`` the chunked others."""

    keys: list[str]
    order: list[Column | str]
    short: DataFrame
    long: DataFrame | None
    written: bool = True
    """Whether ``long`` reads a written table; a second pass over it starts from one."""

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[Column | str], long_series: int = LONG_SERIES) -> OrderedSeries:
        """``order`` should be unique in a series; rows that tie on it must be interchangeable."""
        sizes = larger_than(df, keys, long_series)
        if sizes.isEmpty():
            return OrderedSeries(keys, order, df, None)
        named = materialize(sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n"))
        n_keys, n_rows = named.agg(F.count("*"), F.sum("__n")).first()
        side = named.drop("__n")
        if n_keys <= MAX_BROADCAST_KEYS:
            side = F.broadcast(side)
        # null keys form a series of their own, hence the null-safe comparison
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        # equal rows are told apart by their place in a written table, so that even copies are
        # spread, and a task that runs again gives every row the place it had
        rows = materialize(df.join(side, on, "left_semi")).withColumn(_TIE, F.monotonically_increasing_id())
        # as many chunks as keep each one the size of a short series
        ranged = rows.repartitionByRange(-(-n_rows // long_series), *keys, *order, _TIE)
        ranged = ranged.withColumn(_CHUNK, F.spark_partition_id())
        return OrderedSeries(keys, order, df.join(side, on, "left_anti"), materialize(ranged))

    def add(self, values: dict[str, Running]) -> OrderedSeries:
        """Add running values per series."""
        inputs = {n: r.value for n, r in values.items()}
        within = Window.partitionBy(*self.keys).orderBy(*self.order)
        short = self.short.select("*", *_over(values, inputs, within))
        if self.long is None:
            return replace(self, short=short)
        long = self.long if self.written else materialize(self.long)
        return replace(self, short=short, long=self._add_long(long, values), written=False)

    def _add_long(self, long: DataFrame, values: dict[str, Running]) -> DataFrame:
        columns = long.columns
        named = {n: F.col(f"__in_{n}") for n in values}
        rows = long.withColumns({_CARRY: F.lit(0)} | {f"__in_{n}": r.value for n, r in values.items()})
        place = F.struct(*self.order, _TIE)
        summary = rows.groupBy(*self.keys, _CHUNK).agg(
            *[
                (F.max_by(c, F.when(c.isNotNull(), place)) if values[n].kind == "last" else _combine(values[n].kind, c)).alias(f"__in_{n}")
                for n, c in named.items()
            ]
        )
        # a series has as many summaries as it has chunks, never more than there are sort partitions
        earlier = Window.partitionBy(*self.keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(
            *self.keys,
            _CHUNK,
            F.lit(-1).alias(_CARRY),
            *[_combine(values[n].kind, c).over(earlier).alias(f"__in_{n}") for n, c in named.items()],
        ).where(reduce(or_, [c.isNotNull() for c in named.values()]))
        within = Window.partitionBy(*self.keys, _CHUNK).orderBy(_CARRY, *self.order, _TIE)
        out = rows.unionByName(carry, allowMissingColumns=True).select(*columns, _CARRY, *_over(values, named, within))
        return out.where(F.col(_CARRY) == 0).drop(_CARRY)

    def map(self, change) -> OrderedSeries:
        """Apply a row-wise change (new columns, a filter) to all series."""
        return replace(self, short=change(self.short), long=None if self.long is None else change(self.long))

    def result(self) -> DataFrame:
        return self.short if self.long is None else self.short.unionByName(self.long.drop(_CHUNK, _TIE))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "position", long_series: int = LONG_SERIES) -> DataFrame:
    """Dense row numbers per series, starting at 1."""
    one = Running("sum", F.lit(1).cast("bigint"))
    return OrderedSeries.of(df, keys, order, long_series).add({name: one}).result()


# Entries of one list.
LIST_SIZE = 1000


def bounded_lists(df: DataFrame, keys: list[str], order: list[str], entry: Column, name: str, size: int = LIST_SIZE, long_series: int = LONG_SERIES) -> DataFrame:
    """Ordered lists of at most ``size`` entries per key: ``keys, part, <name>``.

    Part 0 holds the first entries, part 1 the next ones; nothing is left out, and no list
    outgrows a task however many entries a key has. Entries are sorted by the ``order``
    columns and then by their own content; without ``order`` by their content alone.
    """
    if order:
        sort = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)]
        ranked, unwrap = F.struct(*sort, entry.alias("e")), lambda lst: F.transform(lst, lambda x: x["e"])
        plain = F.col("__ranked.e")
    else:
        ranked, unwrap, plain = entry, lambda lst: lst, F.col("__ranked")
    slim = df.select(*keys, ranked.alias("__ranked"))
    if larger_than(df, keys, size).isEmpty():
        # measured: every key fits one list, so no numbering is needed
        lists = slim.groupBy(*keys).agg(F.sort_array(F.collect_list("__ranked")).alias("__l"))
        return lists.select(*keys, F.lit(0).alias("part"), unwrap(F.col("__l")).alias(name))
    numbered = number_rows(slim, keys, ["__ranked"], "__pos", long_series).select(*keys, "__pos", plain.alias("e"))
    part = F.floor((F.col("__pos") - 1) / size).cast("int").alias("part")
    lists = numbered.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct("__pos", "e"))).alias("__l"))
    return lists.select(*keys, "part", F.transform("__l", lambda x: x["e"]).alias(name))
