"""Filters and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_bounds
from ..functions.text import _c
from .joins import distinct_keys, keyed_join


def in_month(df: DataFrame, ts: str, month: str) -> DataFrame:
    """Rows of one month. The bounds are literals of the column's own type, so they reach the scan."""
    first, after = month_bounds(month)
    kind = df.schema[ts].dataType.simpleString()
    return df.where((F.col(ts) >= F.lit(first).cast(kind)) & (F.col(ts) < F.lit(after).cast(kind)))


def site_month(df: DataFrame, site: str, site_id, ts: str, month: str) -> DataFrame:
    return in_month(df, ts, month).where(F.col(site) == site_id)


def where_like(df: DataFrame, col: str, pattern: str, ci: bool = False) -> DataFrame:
    return df.where(F.col(col).ilike(pattern) if ci else F.col(col).like(pattern))


def key_matches(col: Column | str, include: str | None = None, exclude: str | None = None) -> Column:
    """Substring-family test: matches ``include`` and not ``exclude`` (both regular expressions)."""
    c, cond = _c(col), F.lit(True)
    if include is not None:
        cond = cond & c.rlike(include)
    if exclude is not None:
        cond = cond & ~c.rlike(exclude)
    return cond


def where_key(df: DataFrame, col: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    return df.where(key_matches(col, include, exclude))


# The size limit of a limited copy, and what copies leave out.
COPY_LIMIT_BYTES = 2 * 1024 * 1024
COPY_SKIPPED_SUFFIXES = (".tmp", ".temp")
INDEX_SKIPPED_FOLDERS = ("data", "logs")


def transferable(
    df: DataFrame,
    path: str,
    size: str,
    max_bytes: int | None = COPY_LIMIT_BYTES,
    suffixes: tuple[str, ...] = COPY_SKIPPED_SUFFIXES,
    folders: tuple[str, ...] = (),
) -> DataFrame:
    """Files small enough to copy, without skipped suffixes and without skipped path parts."""
    cond = F.lit(True) if max_bytes is None else F.col(size) <= max_bytes
    for suffix in suffixes:
        cond = cond & ~F.col(path).endswith(suffix)
    if folders:
        cond = cond & ~F.arrays_overlap(F.split(F.col(path), "/"), F.array(*[F.lit(f) for f in folders]))
    return df.where(cond)


def not_builtin(df: DataFrame, col: str, builtins: list[str] | DataFrame) -> DataFrame:
    """Rows whose name is none of the built-in names (whole-name match).

    A short list is a literal condition; a table of names (same column) is an anti join.
    """
    if isinstance(builtins, DataFrame):
        return keyed_join(df.where(F.col(col).isNotNull()), distinct_keys(builtins, col), col, "left_anti")
    return df.where(~F.col(col).isin(builtins))


def bad_response(value: Column | str, status: Column | str | None = None) -> Column:
    """Why a response is refused: ``missing`` or ``error``; null when it is good."""
    v = _c(value)
    reason = F.when(v.isNull() | (v == "") | (v == "null"), "missing")
    return reason if status is None else reason.when(_c(status) == "ERROR", "error")


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and refused rows with their ``reason``."""
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def where_path(df: DataFrame, path: str, value) -> DataFrame:
    """Rows whose nested field equals a value; parts of the path are separated by a slash."""
    col = None
    for part in path.split("/"):
        col = F.col(f"`{part}`") if col is None else col.getField(part)
    return df.where(col == value)


def is_empty(array: Column | str) -> Column:
    """True for an array without elements; a missing array is not an empty one."""
    a = _c(array)
    return a.isNotNull() & (F.size(a) == 0)


def where_empty(df: DataFrame, array: str) -> DataFrame:
    return df.where(is_empty(array))


def whole_days_before(ts: Column | str, as_of: dt.datetime | str) -> Column:
    """Completed 24-hour periods between ``ts`` and ``as_of``."""
    ref = F.lit(as_of).cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", _c(ts).cast("timestamp_ntz"), ref)
    return F.floor(seconds / 86400)


def expired(df: DataFrame, ts: str, days: int, name: str, pattern: str, as_of: dt.datetime | str) -> DataFrame:
    """Entries more than ``days`` whole days old whose name matches a LIKE pattern."""
    # whole days since ts exceed ``days`` once ts is a day more than that ago; a plain bound
    # on the column reaches the scan
    bound = (F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days + 1))).cast(df.schema[ts].dataType)
    return df.where((F.col(ts) <= bound) & F.col(name).like(pattern))


def not_allowed(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """Rows with a value outside the allowed list; a missing value counts as outside."""
    return df.where(~F.coalesce(F.col(col).isin(allowed), F.lit(False)))


def require_allowed(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """The same rows back; reading an unknown value is a run-time error."""
    ok = F.coalesce(F.col(col).isin(allowed), F.lit(False))
    message = F.concat(F.lit(f"unknown {col}: "), F.coalesce(F.col(col).cast("string"), F.lit("(none)")))
    return df.withColumn(col, F.when(ok, F.col(col)).otherwise(F.raise_error(message)))
