"""Date functions. The clock is never read: "today" is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# Accepted spellings of a month, a day and a report month.
MONTH_FORMAT = "yyyy-M"
DAY_FORMAT = "yyyy-M-d"
REPORT_MONTH_FORMAT = "M_yyyy"


def _try_date(col: Column | str, fmt: str) -> Column:
    return F.try_to_timestamp(_c(col), F.lit(fmt)).cast("date")


def parse_month(col: Column | str) -> Column:
    """First day of ``YYYY-MM`` (a one-digit month counts); null when malformed."""
    return _try_date(col, MONTH_FORMAT)


def parse_day(col: Column | str) -> Column:
    return _try_date(col, DAY_FORMAT)


def parse_report_month(col: Column | str) -> Column:
    return _try_date(col, REPORT_MONTH_FORMAT)


def strict(parsed: Column, raw: Column | str, expected: str) -> Column:
    """Turn a failed parse of a present value into a run-time error naming it."""
    raw = _c(raw)
    message = F.concat(F.lit("Invalid date format: "), raw, F.lit(f". Expected format is {expected}."))
    return F.when(parsed.isNull() & raw.isNotNull(), F.raise_error(message).cast("date")).otherwise(parsed)


def month_of(col: Column | str) -> Column:
    return F.trunc(_c(col), "month")


def next_month(col: Column | str) -> Column:
    return F.add_months(month_of(col), 1)


def previous_month_end(col: Column | str) -> Column:
    return F.date_sub(month_of(col), 1)


def next_day(col: Column | str) -> Column:
    return F.date_add(_c(col), 1)


def previous_day(col: Column | str) -> Column:
    return F.date_sub(_c(col), 1)


def months_between_inclusive(first: Column | str, last: Column | str) -> Column:
    """Array of month starts from ``first`` to ``last``; empty when ``first`` is later."""
    a, b = month_of(first), month_of(last)
    return F.when(a <= b, F.sequence(a, b, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def month_index(col: Column | str) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return F.year(_c(col)) * 12 + F.month(_c(col)) - 1


def month_bounds(month: str) -> tuple[dt.date, dt.date]:
    """Literal half-open bounds of ``YYYY-MM``; December rolls into the next year."""
    year, number = (int(part) for part in month.split("-"))
    first = dt.date(year, number, 1)
    return first, dt.date(year + number // 12, number % 12 + 1, 1)
