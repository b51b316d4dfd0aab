"""Number functions: guarded integers, truncating percentages, version keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def int_or(col: Column | str, default: int) -> Column:
    """Digits as a long, everything else (signs, blanks, overflow) the default."""
    c = _c(col).cast("string")
    return F.when(c.rlike(r"^[0-9]+\z"), F.coalesce(c.try_cast("bigint"), F.lit(default))).otherwise(F.lit(default)).cast(
        "bigint"
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def percent(part: Column | str, whole: Column | str) -> Column:
    """Truncating integer percentage; null over zero."""
    return _div(_c(part) * 100, _c(whole))


def share(whole: Column | str, hundredths: int) -> Column:
    """Truncated ``hundredths`` percent of a count."""
    return _div(_c(whole) * hundredths, F.lit(100))


def growth_percent(now: Column | str, base: Column | str) -> Column:
    """Change against the base in percent, cut (not rounded) after one decimal."""
    return _div((_c(now) - _c(base)) * 1000, _c(base)) / F.lit(10.0)


def version_key(col: Column | str) -> Column:
    """Version text as an orderable array of numbers, so that 6.10 follows 6.9."""
    return F.transform(F.regexp_extract_all(_c(col), F.lit("([0-9]+)"), 1), lambda p: p.try_cast("bigint"))


def version_lt(a: Column | str, b: Column | str) -> Column:
    return version_key(a) < version_key(b)


def version_has_prefix(version: Column | str, prefix: Column | str) -> Column:
    """Whether a version lies under a release line: 6.6 covers 6.6 and 6.6.1, not 6.60."""
    v, p = version_key(version), version_key(prefix)
    return F.slice(v, F.lit(1), F.size(p)) == p
