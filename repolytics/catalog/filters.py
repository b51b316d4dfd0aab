"""Registered queries: filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import int_or
from ..operators import filters as O
from ..operators import projections as P
from ..plans.reports import usage_details
from ..sources.shapes import iso_day, report_headers, usage_report
from .registry import query


@query(
    "flt_01_in_month",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-12-01' AND o_orderdate < TIMESTAMP '1997-01-01'""",
)
def flt_01(t):
    return O.in_month(t.orders, "o_orderdate", "1996-12").select("o_orderkey", iso_day("o_orderdate").alias("day"))


@query(
    "flt_02_site_month",
    """SELECT event_id, event_type FROM events WHERE user_id = 7
       AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""",
)
def flt_02(t):
    return O.site_month(t.events, "user_id", 7, "ts", "2024-01").select("event_id", "event_type")


@query("flt_03_like", "SELECT page_id, url FROM pages WHERE url ILIKE 'HTTP://%' AND url LIKE '%.html'")
def flt_03(t):
    return O.where_like(O.where_like(t.pages, "url", "HTTP://%", ci=True), "url", "%.html").select("page_id", "url")


@query(
    "flt_04_key_family",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'red|blue|RED') AND NOT regexp_matches(p_name, 'bolt|gear')",
)
def flt_04(t):
    return O.where_key(t.part, "p_name", include="red|blue|RED", exclude="bolt|gear").select("p_partkey", "p_name")


@query(
    "flt_05_transferable",
    """SELECT doc_id, path, n_chars FROM (
         SELECT doc_id, n_chars, source, source || '/' || lang || '/' || doc_id
           || CASE doc_id % 10 WHEN 0 THEN '.tmp' WHEN 1 THEN '.temp' ELSE '.txt' END AS path FROM documents)
       WHERE n_chars <= 2000 AND NOT path LIKE '%.tmp' AND NOT path LIKE '%.temp' AND source <> 'src1'""",
)
def flt_05(t):
    suffix = F.when(F.col("doc_id") % 10 == 0, ".tmp").when(F.col("doc_id") % 10 == 1, ".temp").otherwise(".txt")
    files = t.documents.select(
        "doc_id", "n_chars", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", suffix).alias("path")
    )
    return O.transferable(files, "path", "n_chars", max_bytes=2000, folders=("src1",)).select("doc_id", "path", "n_chars")


@query("flt_06_not_builtin", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de')")
def flt_06(t):
    return O.not_builtin(t.documents, "lang", ["en", "de"]).select("doc_id", "lang")


@query(
    "flt_07_split_valid",
    """SELECT d.doc_id, CASE WHEN quality IS NULL OR quality = 0 THEN 'missing' WHEN toxic = 1 THEN 'error' ELSE 'ok' END AS reason
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def flt_07(t):
    answered = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    answered = answered.select(
        "doc_id",
        F.when(F.col("quality") == 0, "null").otherwise(F.col("quality").cast("string")).alias("value"),
        F.when(F.col("toxic") == 1, "ERROR").otherwise("OK").alias("status"),
    )
    good, refused = O.split_valid(answered, O.bad_response("value", "status"))
    return good.select("doc_id", F.lit("ok").alias("reason")).unionByName(refused.select("doc_id", "reason"))


@query("flt_08_nested_path", "SELECT 'report-' || o_orderkey AS id FROM orders WHERE o_orderdate = TIMESTAMP '1997-05-28'")
def flt_08(t):
    return O.where_path(report_headers(t.orders), "report-header/reporting-period/end-date", "1997-05-28").select("id")


@query(
    "flt_09_empty_array",
    "SELECT CAST(o_orderkey AS VARCHAR) AS uri FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def flt_09(t):
    records = usage_report(t.orders, t.lineitem).select("uri", F.get("performance", F.lit(0))["instance"].alias("instance"))
    return O.where_empty(records, "instance").select("uri")


@query(
    "flt_10_expired",
    """SELECT o_orderkey FROM orders
       WHERE floor(date_diff('second', o_orderdate, TIMESTAMP '2001-08-01 12:00:00') / 86400) > 1500 AND o_orderpriority LIKE '1-%'""",
)
def flt_10(t):
    return O.expired(t.orders, "o_orderdate", 1500, "o_orderpriority", "1-%", "2001-08-01 12:00:00").select("o_orderkey")


@query("flt_11_not_allowed", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr', 'de')")
def flt_11(t):
    return O.not_allowed(t.documents, "lang", ["en", "fr", "de"]).select("doc_id", "lang")


@query(
    "flt_12_int_guard",
    r"""SELECT page_id, CASE WHEN regexp_matches(seg, '^[0-9]+$') THEN CAST(seg AS BIGINT) ELSE 0 END AS n
        FROM (SELECT page_id, string_split(url, '/')[-1] AS seg FROM pages)""",
)
def flt_12(t):
    return t.pages.select("page_id", int_or(F.element_at(F.split("url", "/"), -1), 0).alias("n"))


@query("prj_01_display", "SELECT s_suppkey || ' ' || s_name || ' ' || s_nationkey AS line FROM supplier")
def prj_01(t):
    return t.supplier.select(P.display("s_suppkey", "s_name", "s_nationkey").alias("line"))


@query(
    "prj_02_unpivot_record",
    """SELECT o_orderkey, 'o_orderstatus' AS key, o_orderstatus AS value FROM orders
       UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders
       UNION ALL SELECT o_orderkey, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders
       UNION ALL SELECT o_orderkey, 'cents', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) FROM orders""",
)
def prj_02(t):
    metrics = F.array(F.struct(F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")))
    records = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", metrics.alias("metrics"))
    return P.unpivot_record(records, ["o_orderkey"], "metrics")


@query(
    "prj_03_nested_shape",
    """SELECT CAST(o_orderkey AS VARCHAR) AS uri, 'Dataset ' || o_orderkey AS title,
         '[{"period":{"begin-date":"' || strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') || '","end-date":"'
         || strftime(last_day(o_orderdate), '%Y-%m-%d') || '"},"instance":[]}]' AS performance
       FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def prj_03(t):
    listed = usage_details(usage_report(t.orders, t.lineitem))
    return listed.select("uri", "title", F.to_json("performance").alias("performance"))
