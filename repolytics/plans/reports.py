"""Failed-identifier, resolution, usage and metrics jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_index
from ..functions.markup import failure_items
from ..functions.text import landing_url
from ..operators.aggregates import details, hits, usage_summary
from ..operators.filters import is_empty, site_month, where_path
from ..operators.joins import exclude_denied, keyed_join
from ..operators.ordering import positioned_ci, rank_hits
from ..operators.projections import display, project_nested, unpivot_record


class FailedIdentifiers:
    """Failed-identifier report of a log ``pid, uri, method, ip, time`` without denied sources.

    Lines of one moment follow their log position where the log has one (``pos``).
    """

    def __init__(self, log: DataFrame, deny: DataFrame, base_url: str):
        self.base_url = base_url
        self.kept, self._dropped = exclude_denied(log, deny, "ip")
        self.pos = ["pos"] if "pos" in log.columns else []

    def ranked(self) -> DataFrame:
        """``rank, hits, pid, first_seen, url``, most hits first, equal ones as they first appear."""
        return rank_hits(hits(self.kept, "pid", "time", *self.pos), "pid").withColumn("url", landing_url(self.base_url, "pid"))

    def details(self) -> DataFrame:
        """``pid, position, line`` in log order."""
        written = isinstance(self.kept.schema["time"].dataType, T.StringType)
        at = F.trim("time") if written else F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        line = F.concat("method", F.lit(" "), "uri", F.lit(" from "), "ip", F.lit(" at "), at)
        return details(self.kept, "pid", ["time", *(self.pos or ["uri"])], line)

    def dropped(self) -> DataFrame:
        """One row: log lines from denied sources."""
        return self._dropped

    def message(self) -> DataFrame:
        """One row when there is nothing to report, else none."""
        first = self.kept.limit(1).agg(F.count("*").alias("n"))
        return first.where(F.col("n") == 0).select(F.lit("No Failures this month").alias("message"))


def resolution_failures(reports: DataFrame, account: str, base_url: str) -> DataFrame:
    """Unresolved identifiers of one account from report pages ``report_month, html``."""
    items = reports.select("report_month", F.explode(failure_items("html", account)).alias("i"))
    return items.select("report_month", "i.pid", "i.hits", landing_url(base_url, F.col("i.pid")).alias("url"))


def due_months(last_done: str | None, as_of: dt.date, available: DataFrame) -> DataFrame:
    """Report months to process: from the one after ``last_done`` (or last month when nothing is
    recorded) to last month, stopping before the first month whose report is not there.

    Available months are collected as a set that cannot outgrow the calendar; a month is due
    when it is as far from the first due month as its position in the sorted set.
    """
    last = as_of.year * 12 + as_of.month - 2
    first = last
    if last_done is not None:
        month, year = (int(p) for p in last_done.split("_"))
        first = year * 12 + month
    index = month_index("report_month")
    months = available.where(index.between(first, last)).agg(F.array_sort(F.collect_set(index)).alias("m"))
    due = F.filter("m", lambda x, i: x == i + first)
    return months.select(F.explode(due).alias("i")).select(
        F.make_date(F.call_function("div", F.col("i"), F.lit(12)).cast("int"), F.col("i") % 12 + 1, F.lit(1)).alias("report_month")
    )


def resolution_backfill(reports: DataFrame, account: str, base_url: str, last_done: str | None, as_of: dt.date) -> DataFrame:
    """Failures of all report months that are due."""
    due = due_months(last_done, as_of, reports.select("report_month"))
    return resolution_failures(keyed_join(reports, due, "report_month", "left_semi"), account, base_url)


def usage_check(headers: DataFrame, report: DataFrame, metric: str, day: str) -> dict[str, DataFrame]:
    """Check of a usage report: the reports ending on ``day``, totals, empty records, the alert."""
    found = where_path(headers, "report-header/reporting-period/end-date", day).select("id")
    summary = usage_summary(report, "performance", metric, "part" if "part" in report.columns else None)
    return {
        "found": found,
        "summary": summary.withColumn("alert", (F.col("n") != 0) & (F.col("without_entries") > 0)),
        "empty": usage_details(report, only_empty=True),
    }


def usage_details(report: DataFrame, only_empty: bool = True) -> DataFrame:
    """Nested listing ``title, id, uri, performance``; by default records with an empty entry only."""
    rows = report.where(F.exists("performance", lambda p: is_empty(p["instance"]))) if only_empty else report
    columns = {"dataset-title": "title", "dataset-id": "id", "uri": "uri"}
    return project_nested(rows, columns, "performance", ["period", "instance"])


def installation_listing(sites: DataFrame, site_id: str, name: str, host: str) -> DataFrame:
    """Sites in name order without case, as display lines with their position."""
    return positioned_ci(sites, name, site_id).select("position", display(site_id, name, host).alias("line"))


def site_metrics(metrics: DataFrame, site: str, site_value, ts: str, month: str, ids: list[str], nested: str | None = None) -> DataFrame:
    """Key/value rows of one site's record of one month; no record, no rows."""
    return unpivot_record(site_month(metrics, site, site_value, ts, month).drop(ts, site), ids, nested)

