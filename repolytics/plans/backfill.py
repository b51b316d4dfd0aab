"""Monthly resolution reports: gzip files by month, worked off in order with a saved state.

Files are named ``resolutions_MM_YYYY.html.gz``, or lie in a folder of that name. A report is read as numbered lines, never as one
value. For each account it has a first list (resolved) and a second one (failed), and each
failed identifier is an anchor line with its count two lines below.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_report_month
from ..functions.text import landing_url
from ..operators.joins import keyed_join
from ..sources.readers import read_log
from ..streaming.runner import drain_append, file_stream
from .reports import due_months

REPORT_GLOB = "resolutions_*.html.gz"
_NAME = r"resolutions_(\d{2}_\d{4})\.html\.gz"
# Lines of a file whose marks are followed in one row.
STRETCH = 1024
_SEEN = "path string, modificationTime timestamp, length bigint, content binary"


def failed_sections(lines: DataFrame, file: str, account: str) -> DataFrame:
    """``file, __stretch, sections``: first and last line of the account's failure lists within each
    stretch of ``STRETCH`` lines that holds a mark or an anchor.

    Only marker lines count: the account's heading, list ends and list starts. Behind a heading
    the first end closes the resolved list, the next start opens the failed one, and the next
    end closes it; then the next heading is looked for. A list that is never closed goes on to the
    end. A file may hold any number of lists: what a stretch makes of each of the four steps it
    may begin with is found side by side, these go one after the other over the file, and each
    stretch then finds its own sections from the step it really begins with.
    """
    line = F.col("line")
    close, open_, head = line.contains("</ol>"), line.contains("<ol>"), line.contains(account)
    mark = F.when(close | open_ | head, F.struct("line_no", head.alias("head"), close.alias("close"), open_.alias("open")))
    rows = lines.where(close | open_ | head | line.startswith("<a ")).select(file, _stretch(), mark.alias("m"))
    marked = rows.groupBy(file, "__stretch").agg(F.array_sort(F.collect_list("m")).alias("marks"))

    # one line may carry several marks: the order of tests is that of the search above
    def after(step: Column, m: Column) -> Column:
        moves = [m["head"], m["close"], ~m["close"] & m["open"], m["close"]]
        return F.when(F.element_at(F.array(*moves), step + 1), (step + 1) % 4).otherwise(step)

    ends = F.array(*[F.aggregate("marks", F.lit(s), after) for s in range(4)])
    files = marked.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("__stretch", ends.alias("ends")))).alias("runs"))
    none = F.array().cast("array<struct<__stretch: bigint, step: int>>")

    def run(acc: Column, r: Column) -> Column:
        here = F.array(F.struct(r["__stretch"].alias("__stretch"), acc["step"].alias("step")))
        return F.struct(F.element_at(r["ends"], acc["step"] + 1).alias("step"), F.concat(acc["begun"], here).alias("begun"))

    begun = F.aggregate("runs", F.struct(F.lit(0).alias("step"), none.alias("begun")), run, lambda acc: acc["begun"])
    steps = files.select(file, F.explode(begun).alias("b")).select(file, "b.__stretch", "b.step")
    start = F.struct(F.col("step"), F.lit(-1).cast("bigint").alias("first"), F.array().cast("array<struct<first: bigint, last: bigint>>").alias("found"))

    def section(acc: Column, last: Column) -> Column:
        return F.concat(acc["found"], F.array(F.struct(acc["first"].alias("first"), last.alias("last"))))

    def step(acc: Column, m: Column) -> Column:
        now, number = after(acc["step"], m), m["line_no"].cast("bigint")
        moved = now != acc["step"]
        return F.struct(
            now.alias("step"),
            F.when(moved & (now == 3), number).otherwise(acc["first"]).alias("first"),
            F.when(moved & (now == 0), section(acc, number)).otherwise(acc["found"]).alias("found"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["step"] == 3, section(acc, F.lit(1 << 62))).otherwise(acc["found"])

    found = keyed_join(marked, steps, [file, "__stretch"]).select(file, "__stretch", F.aggregate("marks", start, step, finish).alias("sections"))
    return found.where(F.size("sections") > 0)


def _stretch() -> Column:
    return F.floor(F.col("line_no") / STRETCH).alias("__stretch")


def failure_lines(lines: DataFrame, file: str, account: str) -> DataFrame:
    """``file, line_no, pid, hits`` of the account's failed identifiers, from numbered lines
    ``file, line_no, line``. An anchor without a count two lines below is an error."""
    in_list = F.exists("sections", lambda s: (F.col("line_no") > s["first"]) & (F.col("line_no") < s["last"]))
    links = lines.where(F.col("line").startswith("<a ")).select(file, "line_no", "line", _stretch())
    anchors = keyed_join(links, failed_sections(lines, file, account), [file, "__stretch"]).where(in_list)
    pid = F.regexp_extract("line", r'^[^"]*"[^"]*doi\.org/([^"]*)"', 1)
    count = F.regexp_extract("line", r"\(([^()]*)\)", 1)
    counts = lines.where(F.col("line").contains("(")).select(file, (F.col("line_no") - 2).alias("line_no"), count.alias("count"))
    found = anchors.select(file, "line_no", F.concat(F.lit("doi:"), pid).alias("pid")).join(counts, [file, "line_no"], "left")
    failure = F.raise_error(F.concat(F.lit("no count for "), "pid")).cast("bigint")
    hits = F.trim("count").try_cast("bigint")
    return found.select(file, "line_no", "pid", F.when(hits.isNull(), failure).otherwise(hits).alias("hits"))


class ResolutionBackfill:
    """Works off the report months that are due, each once and in order.

    ``home`` is a folder of the job: ``seen`` (report files met so far, each file once, by an
    incremental load), ``failures/report_month=…`` (results) and ``done`` (months finished). A
    month is recorded after its results are written, so a month that fails is taken up
    again by the next call, and the months behind it wait.
    """

    def __init__(self, spark: SparkSession, reports: str, home: str, account: str, base_url: str, glob: str = REPORT_GLOB):
        self.spark, self.reports, self.home, self.account, self.base_url, self.glob = spark, reports, home, account, base_url, glob

    def _look(self) -> DataFrame:
        """All report files met so far, ``report_month, path``; new ones are added."""
        files = file_stream(self.spark, self.reports, _SEEN, glob=self.glob, kind="binaryFile").select("path")
        month = parse_report_month(F.regexp_extract("path", _NAME, 1))
        drain_append(files.withColumn("report_month", month), f"{self.home}/seen", f"{self.home}/seen-state")
        return self.spark.read.schema("path string, report_month date").parquet(f"{self.home}/seen").where("report_month is not null")

    def _table(self, name: str, schema: str) -> DataFrame:
        # an empty first file makes the table readable before anything is recorded
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.home}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")

    def last_done(self) -> str | None:
        """The last month finished, ``MM_YYYY``."""
        last = self._table("done", "report_month date").agg(F.max("report_month")).first()[0]
        return None if last is None else last.strftime("%m_%Y")

    def run(self, as_of: dt.date) -> list[dt.date]:
        """Process all due months up to the one before ``as_of``; the months that were finished.

        Without a state only the last month is due. The first month whose file is missing ends the
        run. There are as many steps as months, each of them one Spark job.
        """
        seen = self._look()
        months = sorted(r["report_month"] for r in due_months(self.last_done(), as_of, seen).collect())
        for month in months:
            paths = [r["path"] for r in seen.where(F.col("report_month") == F.lit(month)).distinct().collect()]
            found = failure_lines(read_log(self.spark, paths, ordered=True), "path", self.account)
            found.select("line_no", "pid", "hits").write.mode("overwrite").parquet(f"{self.home}/failures/report_month={month}")
            self.spark.createDataFrame([(month,)], "report_month date").write.mode("append").parquet(f"{self.home}/done")
        return months

    def failures(self) -> DataFrame:
        """``report_month, line_no, pid, hits, url`` of all finished months."""
        schema = "line_no bigint, pid string, hits bigint, report_month date"
        done = self._table("done", "report_month date").distinct()
        empty = self.spark.createDataFrame([], schema).drop("report_month")
        empty.write.mode("append").parquet(f"{self.home}/failures/report_month=1970-01-01")
        rows = self.spark.read.schema(schema).parquet(f"{self.home}/failures")
        # results of a month that was not recorded are not shown
        return keyed_join(rows, done, "report_month", "left_semi").withColumn("url", landing_url(self.base_url, "pid"))

    def message(self, as_of: dt.date, finished: list[dt.date]) -> str | None:
        """What to say when no month was finished: the report expected next."""
        if finished:
            return None
        last = self.last_done()
        month, year = (int(p) for p in last.split("_")) if last else (as_of.month - 2, as_of.year)
        index = year * 12 + month
        return f"No new monthly reports. Next report expected: {index % 12 + 1:02d}_{index // 12}"
