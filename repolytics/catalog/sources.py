"""Registered queries: sources and sinks. Files are derived from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import export_name, lines_of
from ..operators.aggregates import monthly_counts
from ..operators.documents import description_fragment, export_description
from ..plans.reports import FailedIdentifiers
from ..session import scratch_path
from ..sources import readers as R
from ..sources import writers as W
from ..sources.shapes import BASE_URL, PID_PREFIX, dataset_rows, description_columns, description_sources, description_ties, failure_log, usage_report
from .registry import query
from .snippets import DESCRIPTIONS, FAILURE_LOG, LINES


@query(
    "src_01_json_rows",
    f"WITH {LINES} SELECT doc_id, line_no, length(line) AS n FROM lines",
)
def src_01(t):
    path = scratch_path(t.spark, "json-rows")
    entry = F.transform(
        lines_of("text"),
        lambda x, i: F.struct(F.col("doc_id").alias("doc_id"), (i + 1).cast("bigint").alias("line_no"), F.length(x).cast("bigint").alias("n")),
    )
    t.spread("documents").select(F.to_json(entry).alias("value")).write.text(path)
    return R.read_json_rows(t.spark, path, "doc_id bigint, line_no bigint, n bigint")


@query(
    "src_02_rows_at_key",
    """SELECT CAST(o_orderkey AS VARCHAR) AS uri, l_returnflag AS metric, CAST(l_quantity AS BIGINT) AS n
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
)
def src_02(t):
    nested = usage_report(t.orders, t.lineitem).select("uri", F.get("performance", F.lit(0))["instance"].alias("instance"))
    return R.rows_at(nested, "instance", keep_parent=True).toDF("uri", "metric", "n")


@query(
    "src_03_tsv_log",
    f"""WITH {FAILURE_LOG} SELECT pid, uri, method, ip, strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS time FROM failure_log""",
)
def src_03(t):
    log = failure_log(t.events).drop("pos").withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    path = W.write_tsv(log, scratch_path(t.spark, "tsv"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("pid", "uri", "method", "ip", "time")])
    return R.read_tsv(t.spark, path, schema)


def rotated(df, key, size, order, text, path, **options):
    """Text files of ``size`` keys each, as a rotated log; rows of a file are in order."""
    rotation = F.floor(F.col(key) / size).alias("rotation")
    files = df.select(rotation, order, F.coalesce(text, F.lit("")).alias("value")).repartition("rotation")
    files.sortWithinPartitions("rotation", order).drop(order).write.partitionBy("rotation").text(path, lineSep="\n", **options)
    return path


def rotation_of(path):
    return F.regexp_extract(path, "rotation=([0-9]+)", 1).cast("bigint").alias("rotation")


@query(
    "src_04_gzip_documents",
    """SELECT page_id // 500 AS rotation, row_number() OVER (PARTITION BY page_id // 500 ORDER BY page_id, i) AS line_no, line
       FROM (SELECT page_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS ls FROM pages))""",
)
def src_04(t):
    path = rotated(t.pages, "page_id", 500, "page_id", F.col("html"), scratch_path(t.spark, "gzip"), compression="gzip")
    return R.read_log(t.spark, path, ordered=True).select(rotation_of("path"), "line_no", "line")


@query(
    "src_05_log_lines",
    """SELECT doc_id // 2000 AS rotation, row_number() OVER (PARTITION BY doc_id // 2000 ORDER BY doc_id, i) AS line_no, line
       FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))""",
)
def src_05(t):
    path = rotated(t.documents, "doc_id", 2000, "doc_id", F.col("text"), scratch_path(t.spark, "log"))
    return R.read_log(t.spark, path, ordered=True).select(rotation_of("path"), "line_no", "line")


FILES_OF_50 = """SELECT doc_id // 50 AS rotation, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS length,
       sha1(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS sha1 FROM documents GROUP BY 1"""


@query("src_06_file_inventory", FILES_OF_50)
def src_06(t):
    path = rotated(t.documents, "doc_id", 50, "doc_id", F.col("text"), scratch_path(t.spark, "inventory"))
    t.region.select("r_name").write.text(f"{path}/rotation=-1", compression="gzip")  # outside the pattern
    return R.hashed_files(t.spark, path, "*.txt")[0].select(rotation_of("path"), "length", "sha1")


@query("src_06_refused_files", f"WITH f AS ({FILES_OF_50}) SELECT rotation, length, 'too large' AS reason FROM f WHERE length > 150000")
def src_06_refused(t):
    path = rotated(t.documents, "doc_id", 50, "doc_id", F.col("text"), scratch_path(t.spark, "inventory"))
    return R.hashed_files(t.spark, path, "*.txt", most=150_000)[1].select(rotation_of("path"), "length", "reason")


@query("src_07_csv_file", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def src_07(t):
    path = scratch_path(t.spark, "csv")
    t.part.select("p_partkey", "p_name", "p_size", "p_retailprice").write.csv(path, header=True)
    return R.read_csv(t.spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query(
    "src_08_dataset_rows",
    """SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_name AS title,
       CASE WHEN p_partkey % 3 = 0 THEN p_type || chr(10) || '"' || p_brand || '",' || chr(10) || chr(10) || 'end' ELSE p_type END AS description,
       p_brand AS agency, p_type AS link_name,
       CASE WHEN p_partkey % 2 = 0 THEN 'https://data.example.org/source/' || p_partkey END AS link_url FROM part""",
)
def src_08(t):
    path = scratch_path(t.spark, "rows")
    # every third description holds line breaks, quotes and a comma
    broken = F.concat("p_type", F.lit('\n"'), "p_brand", F.lit('",\n\nend'))
    description = F.when(F.col("p_partkey") % 3 == 0, broken).otherwise(F.col("p_type"))
    dataset_rows(t.part, description).write.csv(path, header=True, quote='"', escape='"')
    return R.read_dataset_rows(t.spark, path)


@query("src_09_table_scan", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def src_09(t):
    return R.read_table(t.spark, f"{t.folder}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")


def written_report(t):
    deny = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").cast("string").alias("ip"))
    report = FailedIdentifiers(failure_log(t.events), deny, BASE_URL)
    period = F.lit("2024-01").alias("period")
    ranked = report.ranked().select("rank", "hits", "pid", "url", period)
    details = report.details().select("pid", "position", "line", period)
    path = W.write_report(ranked, details, scratch_path(t.spark, "report"), "period")
    return W.read_report(
        t.spark, path, "rank bigint, hits bigint, pid string, url string, period string", "pid string, position bigint, line string, period string"
    )


@query(
    "snk_01_period_report",
    f"""WITH {FAILURE_LOG}, h AS (SELECT pid, count(*) AS hits, min(ROW(time, event_id)) AS first_seen FROM kept GROUP BY pid)
        SELECT '2024-01' AS period, row_number() OVER (ORDER BY hits DESC, first_seen, pid) AS rank, hits, pid,
               'https://data.example.org/dataset.xhtml?persistentId=' || pid AS url
        FROM h""",
)
def snk_01(t):
    return written_report(t)[0]


@query(
    "snk_01_period_details",
    f"""WITH {FAILURE_LOG} SELECT '2024-01' AS period, pid, row_number() OVER (PARTITION BY pid ORDER BY time, event_id) AS position,
        method || ' ' || uri || ' from ' || ip || ' at ' || strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS line FROM kept""",
)
def snk_01_details(t):
    return written_report(t)[1]


@query(
    "snk_02_documents",
    f"""WITH {DESCRIPTIONS} SELECT 'croissant_doi_10.5072_' || o_orderkey || strftime(o_orderdate, '_%Y%m%d_%H%M%S') || '.json' AS doc_name, place, fragment
        FROM descriptions JOIN orders USING (o_orderkey)""",
)
def snk_02(t):
    shape = description_columns()
    datasets, files = description_sources(t.orders, t.lineitem)
    names = t.orders.select("o_orderkey", export_name(F.concat(F.lit(PID_PREFIX), "o_orderkey"), "o_orderdate").alias("doc_name"))
    placed = export_description(datasets, files, "o_orderkey", ["@id", "contentSize"], shape=shape, ties=description_ties())
    # rows are dealt by their key already: a plain join keeps them where they are, and the
    # chunks of long documents, which are not, are shuffled and split by it as needed
    named = placed.join(names, "o_orderkey")
    path = W.write_documents(named, scratch_path(t.spark, "documents"), "doc_name", "gzip", description_fragment(shape))
    return W.read_documents(t.spark, path)


@query(
    "snk_03_snapshot",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL",
)
def snk_03(t):
    path = W.write_snapshot(monthly_counts(t.orders, "o_orderdate"), scratch_path(t.spark, "snapshot"))
    return W.read_snapshot(t.spark, path, "month string, n bigint")
