"""Registered queries: column functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import json as J
from ..functions import markup as M
from ..functions import numbers as N
from ..functions import text as X
from ..operators.search import search, write_postings
from ..plans.reports import resolution_failures
from ..session import scratch_path
from ..sources.shapes import BASE_URL, iso_day, launch_options, link_lines, resolution_reports, usage_report
from .registry import query
from .snippets import ANCHORS, LAUNCH_OPTIONS


@query(
    "str_01_clean_cell",
    "SELECT doc_id, md5(replace(replace(coalesce(text, ''), '’', ''''), '–', '-')) AS cleaned FROM documents",
)
def str_01(t):
    return t.spread("documents").select("doc_id", F.md5(X.clean_cell("text")).alias("cleaned"))


@query(
    "str_02_file_names",
    """SELECT page_id, replace(replace(url, ':', '_'), '/', '_') AS file_name, replace(url, '/', '_') || '_1.2' AS folder_name FROM pages""",
)
def str_02(t):
    return t.pages.select("page_id", X.file_name_of("url").alias("file_name"), X.folder_name_of("url", F.lit("1.2")).alias("folder_name"))


@query(
    "str_03_urls",
    """SELECT page_id, 'https://data.example.org/dataset.xhtml?persistentId=' || url AS landing,
         rtrim(url, '/') || '/api/datasets/export?exporter=croissant&persistentId=doi:' || page_id || '&version=:draft' AS export FROM pages""",
)
def str_03(t):
    return t.pages.select(
        "page_id",
        X.landing_url(BASE_URL, "url").alias("landing"),
        X.export_url(F.col("url"), F.concat(F.lit("doi:"), F.col("page_id")), "croissant").alias("export"),
    )


@query(
    "str_04_percent_decode",
    """SELECT page_id, 'a b+' || replace(url, '=', ' ') AS decoded FROM pages""",
)
def str_04(t):
    encoded = F.concat(F.lit("a%20b+"), F.replace("url", F.lit("="), F.lit("%20")))
    return t.pages.select("page_id", X.percent_decode(encoded).alias("decoded"))


@query("str_05_safe_names", "SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z0-9._-]', '', 'g') AS name FROM pages")
def str_05(t):
    return t.pages.select("page_id", X.safe_name(M.inner_text("html", "title")).alias("name"))


@query("str_06_base_name", "SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS name FROM pages")
def str_06(t):
    return t.pages.select("page_id", X.base_name("url").alias("name"))


@query(
    "str_07_anchor",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN NULL
         ELSE '<a href="' || url || '">page ' || page_id || '</a>' END AS link FROM pages""",
)
def str_07(t):
    target = F.when(F.col("page_id") % 3 == 1, "").when(F.col("page_id") % 3 == 2, F.col("url"))
    return t.pages.select("page_id", X.anchor(target, F.concat(F.lit("page "), F.col("page_id"))).alias("link"))


@query(
    "str_08_index_links",
    f"""WITH {ANCHORS} SELECT page_id, line_no, CASE WHEN i % 3 = 2 THEN 'folder' ELSE 'file' END AS kind, label,
      CASE WHEN i % 3 = 2 THEN '/api/datasets/' || page_id || '/dirindex/?folder=dir%20' || i ELSE '/api/access/datafile/' || (page_id * 1000 + i) END AS target,
      CASE WHEN i % 3 = 2 THEN 'dir ' || i ELSE '' END AS folder FROM link_lines""",
)
def str_08(t):
    kind = F.when(M.is_file_link("line"), "file").when(M.is_folder_link("line"), "folder")
    return link_lines(t.pages).select(
        "page_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        kind.alias("kind"),
        M.last_link_label("line").alias("label"),
        M.last_link_target("line").alias("target"),
        M.folder_of("line").alias("folder"),
    )


@query(
    "str_08_page_links",
    """SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS target FROM pages""",
)
def str_08_pages(t):
    return t.pages.select("page_id", F.explode(M.link_targets("html")).alias("target"))


@query(
    "str_09_failure_items",
    r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages),
        i AS (SELECT page_id, unnest(range(0, len(l))) AS i FROM a)
        SELECT strftime(DATE '2024-01-01' + to_months(CAST(page_id % 7 AS INTEGER)), '%Y-%m') AS month,
               'doi:10.5072/' || (page_id * 1000 + i) AS pid, i * 3 + page_id % 5 AS hits,
               'https://data.example.org/dataset.xhtml?persistentId=doi:10.5072/' || (page_id * 1000 + i) AS url FROM i""",
)
def str_09(t):
    found = resolution_failures(resolution_reports(t.pages), "ACME.REPO", BASE_URL)
    return found.select(F.date_format("report_month", "yyyy-MM").alias("month"), "pid", "hits", "url")


@query("str_10_option_normalise", f"WITH {LAUNCH_OPTIONS} SELECT pos, opt AS option, okey AS key FROM listing WHERE opt IS NOT NULL")
def str_10(t):
    rows = launch_options(t.part).select("pos", X.option_text("raw").alias("option")).where(F.col("option").isNotNull())
    return rows.withColumn("key", X.option_key("option"))


@query(
    "str_11_quote_url_value",
    f"""WITH {LAUNCH_OPTIONS} SELECT pos, CASE WHEN pos % 7 = 3 THEN regexp_replace(opt, '=(.*)$', '=''\\1''') ELSE opt END AS option
        FROM listing WHERE opt IS NOT NULL""",
)
def str_11(t):
    rows = launch_options(t.part).select("pos", X.option_text("raw").alias("option")).where(F.col("option").isNotNull())
    return rows.select("pos", X.quote_url_value("option").alias("option"))


@query(
    "str_12_attributes",
    """SELECT page_id, regexp_extract(html, '\\blang="([^"]*)"', 1) AS lang, regexp_extract(html, '\\bcharset="([^"]*)"', 1) AS charset,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""",
)
def str_12(t):
    return t.pages.select(
        "page_id", M.attribute("html", "lang").alias("lang"), M.attribute("html", "charset").alias("charset"), M.inner_text("html", "title").alias("title")
    )


@query(
    "str_13_rewrite",
    """SELECT page_id, md5(CASE WHEN contains(html, 'lang="en"') THEN regexp_replace(html, 'href="/', 'href="/new/', 'g') ELSE html END) AS html FROM pages""",
)
def str_13(t):
    return t.pages.select("page_id", F.md5(X.rewrite("html", 'href="/', 'href="/new/', marker='lang="en"')).alias("html"))


@query("str_14_strip_unsafe", "SELECT p_partkey, p_name || 'x' AS name FROM part")
def str_14(t):
    return t.part.select("p_partkey", X.strip_unsafe(F.concat("p_name", F.lit("';\\x"))).alias("name"))


@query(
    "str_15_numbers_in_text",
    """SELECT page_id, TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) AS page_no, page_id AS collections, length(html) AS datasets FROM pages""",
)
def str_15(t):
    message = F.concat(F.col("page_id"), F.lit(" collections and "), F.length("html"), F.lit(" datasets"))
    return t.pages.select(
        "page_id",
        X.number_after("url", "page=").alias("page_no"),
        X.number_before(message, "collections").alias("collections"),
        X.number_before(message, "datasets").alias("datasets"),
    )


def posted(t):
    return write_postings(t.spread("documents"), "doc_id", "text", scratch_path(t.spark, "postings"))


@query(
    "str_16_keyword_search",
    r"""WITH h AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w IN ('the', 'la', 'und'))) AS hits FROM documents)
        SELECT row_number() OVER (ORDER BY hits DESC, doc_id) AS position, doc_id, hits FROM h WHERE hits > 0""",
)
def str_16(t):
    return search(t.spark, posted(t), "doc_id", ["the", "la", "und"])


@query(
    "str_16_best_hits",
    r"""WITH h AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w IN ('the', 'la', 'und'))) AS hits FROM documents)
        SELECT row_number() OVER (ORDER BY hits DESC, doc_id) AS position, doc_id, hits FROM h WHERE hits > 0 ORDER BY position LIMIT 10""",
)
def str_16_best(t):
    return search(t.spark, posted(t), "doc_id", ["the", "la", "und"], limit=10)


@query(
    "dt_01_strict_parse",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-01') END AS month,
         strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-01') AS report_month FROM orders""",
)
def dt_01(t):
    raw = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy/MM")).otherwise(F.date_format("o_orderdate", "yyyy-M"))
    rows = t.orders.select(
        "o_orderkey",
        raw.alias("m"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.date_format("o_orderdate", "MM_yyyy").alias("r"),
    )
    return rows.select(
        "o_orderkey",
        iso_day(D.parse_month("m")).alias("month"),
        iso_day(D.strict(D.parse_day("d"), "d", "YYYY-MM-DD")).alias("day"),
        iso_day(D.parse_report_month("r")).alias("report_month"),
    )


@query(
    "dt_02_month_steps",
    """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS following,
         strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS previous_end FROM orders""",
)
def dt_02(t):
    return t.orders.select(
        "o_orderkey", iso_day(D.next_month("o_orderdate")).alias("following"), iso_day(D.previous_month_end("o_orderdate")).alias("previous_end")
    )


@query(
    "dt_03_month_sequence",
    """SELECT month, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
         SELECT o_orderkey, strftime(unnest(generate_series(date_trunc('month', o_orderdate), TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)), '%Y-%m') AS month
         FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01') GROUP BY month""",
)
def dt_03(t):
    months = D.months_between_inclusive("o_orderdate", F.lit("2001-06-30").cast("date"))
    rows = t.orders.select("o_orderkey", F.explode(months).alias("m"))
    return rows.groupBy(F.date_format("m", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "dt_04_neighbour_days",
    """SELECT event_id, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS before, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS after FROM events""",
)
def dt_04(t):
    return t.events.select("event_id", iso_day(D.previous_day("ts")).alias("before"), iso_day(D.next_day("ts")).alias("after"))


@query(
    "mth_01_percentages",
    """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS k, count(*) AS n FROM orders GROUP BY 1)
       SELECT CAST(a.k AS INTEGER) AS k, a.n * 100 // b.n AS percent, trunc((a.n - b.n) * 1000.0 / b.n) / 10.0 AS growth FROM m a JOIN m b ON a.k = b.k + 1""",
)
def mth_01(t):
    m = t.orders.groupBy(D.month_index("o_orderdate").alias("k")).agg(F.count("*").alias("n"))
    base = m.select((F.col("k") + 1).alias("k"), F.col("n").alias("base"))
    return m.join(base, "k").select("k", N.percent("n", "base").alias("percent"), N.growth_percent("n", "base").alias("growth"))


@query("hsh_01_digests", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def hsh_01(t):
    return t.spread("documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("jsn_01_path", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def jsn_01(t):
    return t.events.select("event_id", J.path("props", "k").cast("bigint").alias("k"))


@query(
    "jsn_02_first_alternative",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR) WHEN event_id % 4 = 3 THEN 'false'
         WHEN event_id % 2 = 1 THEN 'b' || event_id ELSE 'none' END AS value FROM events""",
)
def jsn_02(t):
    k = F.col("event_id")
    a = F.when(k % 3 == 0, "null").when(k % 3 == 1, "false").otherwise(k.cast("string"))
    # the text "false" is a value, the boolean is none
    b = F.when(k % 2 == 0, "null").when(k % 4 == 3, '"false"').otherwise(F.concat(F.lit('"b'), k, F.lit('"')))
    doc = F.concat(F.lit('{"a": '), a, F.lit(', "b": '), b, F.lit("}"))
    return t.events.select("event_id", J.first_alternative(doc, "$.a", "$.b", default="none").alias("value"))


@query(
    "jsn_03_listing_lookup",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS file_id FROM orders",
)
def jsn_03(t):
    name = F.concat(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, ".txt").otherwise(".csv"))
    listing = F.concat(F.lit('{"other.txt":{"dataFile":{"id":-1}},"'), name, F.lit('":{"dataFile":{"id":'), F.col("o_custkey"), F.lit("}}}"))
    return t.orders.select("o_orderkey", J.listing_file_id(listing, F.concat(F.col("o_orderkey"), F.lit(".txt"))).alias("file_id"))


@query(
    "jsn_04_chain_explode",
    """SELECT l_returnflag AS metric, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS n
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def jsn_04(t):
    rows = (
        usage_report(t.orders, t.lineitem)
        .select(F.explode("performance").alias("p"))
        .select(F.substring("p.period.begin-date", 1, 7).alias("month"), F.explode("p.instance").alias("i"))
    )
    return rows.groupBy(F.col("i.metric-type").alias("metric"), "month").agg(F.sum("i.count").alias("total"), F.count("*").alias("n"))


@query(
    "jsn_05_registration_record",
    """SELECT doc_id, '{"description":"NetCDF file upload.","directoryLabel":"data/netcdf","categories":["Data"],"restrict":"false","storageIdentifier":"s3://bucket:'
         || doc_id || '","fileName":"' || doc_id || '.nc","mimeType":"application/x-netcdf","checksum":{"@type":"SHA-1","@value":"' || sha1(text) || '"}}' AS record FROM documents""",
)
def jsn_05(t):
    record = J.registration_record(
        F.concat(F.lit("s3://bucket:"), F.col("doc_id")),
        F.concat(F.col("doc_id"), F.lit(".nc")),
        F.sha1("text"),
        F.lit("application/x-netcdf"),
        "NetCDF file upload.",
        "data/netcdf",
        "Data",
    )
    return t.documents.select("doc_id", record.alias("record"))


@query(
    "jsn_06_membership",
    """SELECT CAST(o_orderkey AS VARCHAR) AS uri, count(l_orderkey) AS n, coalesce(bool_or(l_returnflag = 'R'), false) AS has_r
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def jsn_06(t):
    instance = F.get("performance", F.lit(0))["instance"]
    records = usage_report(t.orders, t.lineitem).select(
        "uri", F.size(J.names_in(instance, "metric-type")).alias("n"), J.has_name(instance, "metric-type", "R").alias("has_r")
    )
    # the parts of a large record count as one
    return records.groupBy("uri").agg(F.sum("n").alias("n"), F.coalesce(F.bool_or("has_r"), F.lit(False)).alias("has_r"))
