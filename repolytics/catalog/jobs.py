"""Registered queries: whole jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.documents import build_metadata, flatten_metadata
from ..operators.ordered import number_rows
from ..plans import files as PF
from ..plans import integrity as PI
from ..plans import reports as PR
from ..plans.backfill import ResolutionBackfill
from ..session import scratch_path
from ..sources.readers import file_inventory, read_dataset_rows
from ..sources.shapes import (
    BASE_URL,
    catalog,
    dataset_rows,
    deploy_log,
    failure_log,
    folder_indexes,
    launch_options,
    link_lines,
    property_lines,
    report_headers,
    resolution_reports,
    upload_files,
    usage_report,
)
from .aggregates import CONSISTENCY_SQL, consistency_rules
from .documents import CONTACT
from .joins import COVERAGE_SQL, LEVELS_SQL, denied, level_tables
from .registry import query
from .snippets import ANCHORS, DEPLOY_LOG, FAILURE_LOG, FLAT_FIELDS, LAUNCH_OPTIONS
from .sources import rotated


def failed(t):
    deny = denied(t).select(F.col("user_id").cast("string").alias("ip"))
    return PR.FailedIdentifiers(failure_log(t.events), deny, BASE_URL)


@query(
    "job_01_failed_identifiers",
    f"""WITH {FAILURE_LOG}, h AS (SELECT pid, count(*) AS hits, min(ROW(time, event_id)) AS first_seen FROM kept GROUP BY pid)
        SELECT row_number() OVER (ORDER BY hits DESC, first_seen, pid) AS rank, hits, pid,
               'https://data.example.org/dataset.xhtml?persistentId=' || pid AS url FROM h""",
)
def job_01(t):
    return failed(t).ranked().select("rank", "hits", "pid", "url")


@query(
    "job_01_details",
    f"""WITH {FAILURE_LOG} SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY time, event_id) AS position,
        method || ' ' || uri || ' from ' || ip || ' at ' || strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS line FROM kept""",
)
def job_01_details(t):
    return failed(t).details()


@query(
    "job_02_resolution_backfill",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages),
       i AS (SELECT page_id, unnest(range(0, len(l))) AS i FROM a WHERE page_id % 7 IN (2, 3) )
       SELECT '2024-0' || (page_id % 7 + 1) AS month, 'doi:10.5072/' || (page_id * 1000 + i) AS pid, i * 3 + page_id % 5 AS hits FROM i""",
)
def job_02(t):
    # May (page_id % 7 = 4) is missing, so the backfill stops before it
    reports = resolution_reports(t.pages).where("page_id % 7 <> 4")
    found = PR.resolution_backfill(reports, "ACME.REPO", BASE_URL, "02_2024", dt.date(2024, 9, 10))
    return found.select(F.date_format("report_month", "yyyy-MM").alias("month"), "pid", "hits")


@query(
    "job_03_usage_check",
    """WITH e AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
       s AS (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A')
       SELECT total, n, (SELECT count(*) FROM e WHERE n > 0) AS with_entries, (SELECT count(*) FROM e WHERE n = 0) AS without_entries,
              n <> 0 AND (SELECT count(*) FROM e WHERE n = 0) > 0 AS alert FROM s""",
)
def job_03(t):
    return PR.usage_check(report_headers(t.orders), usage_report(t.orders, t.lineitem), "A", "1997-05-28")["summary"]


@query(
    "job_04_installation_listing",
    """SELECT row_number() OVER (ORDER BY lower(c_name), c_custkey) AS position, c_custkey || ' ' || c_name || ' ' || c_mktsegment AS line FROM customer""",
)
def job_04(t):
    return PR.installation_listing(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", "c_name", "c_mktsegment")


@query(
    "job_04_site_metrics",
    """WITH r AS (SELECT * FROM orders WHERE o_custkey % 50 = 7 AND o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-01-01')
       SELECT o_orderkey, 'o_orderstatus' AS key, o_orderstatus AS value FROM r
       UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM r""",
)
def job_04_metrics(t):
    records = t.orders.select(
        "o_orderkey",
        (F.col("o_custkey") % 50).alias("site"),
        "o_orderdate",
        "o_orderstatus",
        F.array(F.struct(F.col("o_orderpriority").alias("priority"))).alias("metrics"),
    )
    return PR.site_metrics(records, "site", 7, "o_orderdate", "1997-12", ["o_orderkey"], "metrics")


@query("job_05_template_coverage", COVERAGE_SQL)
def job_05(t):
    return PI.template_coverage(catalog(t, "1995-02-01")).select("parent_name", "template_id", "block", "status")


@query("job_05_template_levels", LEVELS_SQL)
def job_05_levels(t):
    return PI.template_levels(*level_tables(t)).select("parent_name", "field", "include", "required")


@query(
    "job_02_saved_state",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages),
       i AS (SELECT page_id, unnest(range(0, len(l))) AS i FROM a WHERE page_id % 7 IN (1, 2, 3) )
       SELECT '2024-0' || (page_id % 7 + 1) AS month, 'doi:10.5072/' || (page_id * 1000 + i) AS pid, i * 3 + page_id % 5 AS hits FROM i""",
)
def job_02_state(t):
    """Gzip reports by month; May is missing. The first call does February, the second one goes on from there."""
    reports = resolution_reports(t.pages).where("page_id % 7 <> 4")
    name = F.concat(F.lit("resolutions_"), F.date_format("report_month", "MM_yyyy"), F.lit(".html.gz")).alias("report")
    folder, home = scratch_path(t.spark, "reports"), scratch_path(t.spark, "backfill")
    files = reports.select(name, "page_id", "html").repartition("report").sortWithinPartitions("report", "page_id").drop("page_id")
    files.write.partitionBy("report").text(folder, compression="gzip", lineSep="\n")
    for day in (dt.date(2024, 3, 5), dt.date(2024, 9, 10)):
        backfill = ResolutionBackfill(t.spark, folder, home, "ACME.REPO", BASE_URL, glob="*.gz")
        backfill.run(day)
    return backfill.failures().select(F.date_format("report_month", "yyyy-MM").alias("month"), "pid", "hits")


def catalog_tables(t):
    """Catalog tables: templates are regions, owned by one of their nations; parents are nations, whose
    default is their region's template; blocks are segments, field types part types."""
    n = F.col("n_nationkey")
    types = t.part.groupBy("p_type").agg(F.min("p_size").cast("bigint").alias("display_order"), F.min("p_brand").alias("brand"))
    return {
        "template": t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") != 3, F.col("r_regionkey") * 5).alias("owner_id")),
        "parent": t.nation.select(n.alias("id"), F.col("n_name").alias("name"), F.when(n % 4 != 1, F.col("n_regionkey")).alias("default_template_id")),
        "block": t.part.select(F.col("p_brand").alias("id"), F.concat(F.lit("block "), "p_brand").alias("name")).distinct(),
        "enabled": t.supplier.join(t.part, F.col("s_suppkey") % 100 == F.col("p_partkey") % 100).select(F.col("s_nationkey").alias("parent_id"), F.col("p_brand").alias("block_id")).distinct(),
        "template_field": t.part.select((F.col("p_partkey") % 5).alias("template_id"), F.col("p_type").alias("field_type_id")).distinct(),
        "field_type": types.select(F.col("p_type").alias("id"), F.lower("p_type").alias("name"), F.col("brand").alias("block_id"), "display_order"),
        "level": t.customer.groupBy(F.col("c_nationkey").alias("parent_id"), F.lit("PROMO").alias("field_type_id")).agg((F.count("*") % 2 == 0).alias("include"), F.lit(True).alias("required")),
    }


CATALOG_SQL = """template AS (SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey <> 3 THEN r_regionkey * 5 END AS owner_id FROM region),
  parent AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 4 <> 1 THEN n_regionkey END AS default_template_id FROM nation),
  enabled AS (SELECT DISTINCT s_nationkey AS parent_id, p_brand AS block_id FROM supplier JOIN part ON s_suppkey % 100 = p_partkey % 100),
  field_type AS (SELECT p_type AS id, lower(p_type) AS name, min(p_size) AS display_order, min(p_brand) AS block_id FROM part GROUP BY 1),
  template_field AS (SELECT DISTINCT p_partkey % 5 AS template_id, p_type AS field_type_id FROM part),
  level AS (SELECT c_nationkey AS parent_id, 'PROMO' AS field_type_id, count(*) % 2 = 0 AS include, true AS required FROM customer GROUP BY 1),
  users AS (SELECT t.id AS template_id, t.name AS template_name, p.id AS parent_id, p.name AS parent_name FROM template t JOIN parent p ON t.id = p.default_template_id
            UNION SELECT t.id, t.name, p.id, p.name FROM template t JOIN parent p ON t.owner_id = p.id)"""


@query(
    "job_05_associations",
    f"""WITH {CATALOG_SQL} SELECT t.id AS template_id, t.name AS template_name, p.id AS parent_id, p.name AS parent_name, p.default_template_id
        FROM template t LEFT JOIN parent p ON t.owner_id = p.id""",
)
def job_05_associations(t):
    return PI.TemplateCheck(catalog_tables(t)).associations().select("template_id", "template_name", "parent_id", "parent_name", "default_template_id")


@query(
    "job_05_check_coverage",
    f"""WITH {CATALOG_SQL}, blocks AS (SELECT DISTINCT template_id, block_id FROM template_field JOIN field_type ON field_type_id = id)
        SELECT row_number() OVER (ORDER BY u.template_id, parent_name, 'block ' || b.block_id, u.parent_id) AS position, template_name, parent_name,
               'block ' || b.block_id AS block, CASE WHEN e.block_id IS NULL THEN 'MISSING' ELSE 'ENABLED' END AS status
        FROM users u JOIN blocks b USING (template_id) LEFT JOIN enabled e ON e.parent_id = u.parent_id AND e.block_id = b.block_id""",
)
def job_05_check_coverage(t):
    return PI.TemplateCheck(catalog_tables(t)).coverage()


@query(
    "job_05_check_levels",
    f"""WITH {CATALOG_SQL} SELECT row_number() OVER (ORDER BY u.template_id, parent_name, display_order, f.name, u.parent_id) AS position, template_name, parent_name,
               f.name AS field, coalesce(l.include, true) AS include, coalesce(l.required, false) AS required
        FROM users u JOIN template_field tf USING (template_id) JOIN field_type f ON f.id = tf.field_type_id
        LEFT JOIN level l ON l.parent_id = u.parent_id AND l.field_type_id = f.id""",
)
def job_05_check_levels(t):
    return PI.TemplateCheck(catalog_tables(t)).levels()


def drift(t):
    listing = launch_options(t.part)
    a, b = (listing.where(F.col("listing") == kind).select("pos", "raw") for kind in ("PROMO", "SMALL"))
    return PI.config_drift(a, b, "raw", "gizmo")


@query(
    "job_06_options_to_add",
    f"""WITH {LAUNCH_OPTIONS} SELECT DISTINCT okey AS key, opt AS option,
          CASE WHEN opt LIKE '-D%=https://%' THEN regexp_replace(opt, '=(.*)$', '=''\\1''') ELSE opt END AS to_set FROM listing
        WHERE listing = 'PROMO' AND opt IS NOT NULL AND NOT regexp_matches(okey, 'gizmo')
          AND okey NOT IN (SELECT okey FROM listing WHERE listing = 'SMALL' AND okey IS NOT NULL)""",
)
def job_06(t):
    return drift(t)["to_add"]


@query(
    "job_06_repeated_keys",
    f"""WITH {LAUNCH_OPTIONS}, d AS (SELECT DISTINCT opt, okey FROM listing WHERE listing = 'PROMO' AND opt IS NOT NULL)
        SELECT okey AS key, opt AS option, count(*) OVER (PARTITION BY okey) AS n FROM d QUALIFY n > 1""",
)
def job_06_repeated(t):
    return drift(t)["repeated"]


@query(
    "job_06_option_diff",
    f"""WITH {LAUNCH_OPTIONS}, c AS (SELECT opt, okey, sum(CASE WHEN listing = 'PROMO' THEN 1 ELSE -1 END) AS n FROM listing
          WHERE listing IN ('PROMO', 'SMALL') AND opt IS NOT NULL GROUP BY ALL)
        SELECT opt AS option, okey AS key, CASE WHEN n > 0 THEN 'old' ELSE 'new' END AS side, CAST(abs(n) AS BIGINT) AS copies FROM c WHERE n <> 0""",
)
def job_06_diff(t):
    return drift(t)["diff"]


@query(
    "job_06_later_options",
    f"""WITH {LAUNCH_OPTIONS} SELECT pos, opt AS option, okey AS key FROM listing WHERE listing = 'PROMO' AND opt IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY okey ORDER BY pos) > 1""",
)
def job_06_later(t):
    listing = launch_options(t.part).where("listing = 'PROMO'")
    return PI.later_options(listing, "pos", "raw").select("pos", "option", "key")


@query(
    "job_06_family_options",
    f"""WITH {LAUNCH_OPTIONS}, f AS (SELECT opt, okey FROM listing WHERE opt LIKE '-D%=%' AND regexp_matches(okey, 'red|hot'))
        SELECT DISTINCT opt AS option, okey AS key, count(*) OVER (PARTITION BY okey) AS n FROM f""",
)
def job_06_family(t):
    return PI.family_options(launch_options(t.part), "raw", "red|hot").select("option", "key", "n")


@query(
    "job_06_properties_to_sync",
    """SELECT 'site.' || replace(p_name, ' ', '.') AS name, p_brand AS value FROM part
       WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 4 <> 0""",
)
def job_06_properties(t):
    return PI.properties_to_sync(property_lines(t.part), "line", "storage|S3")


@query("job_05_find_template", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def job_05_find(t):
    return PI.find_template(t.nation, "7", "n_nationkey", "n_name").select("n_nationkey", "n_name")


def index_check(t):
    db_rules, index_rules = consistency_rules()
    db = t.orders.withColumn("key", F.col("o_orderkey"))
    return PI.index_consistency(db, t.lineitem.withColumn("key", F.col("l_orderkey")), "key", db_rules, index_rules)


@query("job_07_index_verdicts", CONSISTENCY_SQL)
def job_07(t):
    return index_check(t)["verdicts"]


@query(
    "job_07_unmatched_keys",
    """SELECT o_orderkey AS key, count(*) AS n_a, CAST(0 AS BIGINT) AS n_b, 'a_only' AS status FROM orders
       WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""",
)
def job_07_unmatched(t):
    return index_check(t)["unmatched"]


LOG_PATTERNS = {"relation_errors": "ERROR.*relation", "fatal": "FATAL", "policy": "default.policy"}


@query(
    "job_07_error_counts",
    f"""WITH {DEPLOY_LOG} SELECT count(*) FILTER (regexp_matches(line, 'ERROR.*relation')) AS relation_errors,
        count(*) FILTER (regexp_matches(line, 'FATAL')) AS fatal, count(*) FILTER (regexp_matches(line, 'default.policy')) AS policy FROM deploy_log""",
)
def job_07_counts(t):
    return PI.index_errors(deploy_log(t.spread("events")), "line", LOG_PATTERNS, 3, "pos")["counts"]


@query(
    "job_07_recent_errors",
    f"WITH {DEPLOY_LOG} SELECT run, pos, line FROM deploy_log WHERE regexp_matches(line, 'ERROR.*relation') ORDER BY pos DESC LIMIT 3",
)
def job_07_recent(t):
    return PI.index_errors(deploy_log(t.spread("events")), "line", LOG_PATTERNS, 3, "pos")["recent"]


@query(
    "job_07_error_surroundings",
    f"""WITH {DEPLOY_LOG}, hits AS (SELECT run, pos FROM deploy_log WHERE regexp_matches(line, 'FATAL')),
        n AS (SELECT run, pos, line, row_number() OVER (PARTITION BY run ORDER BY pos) AS line_no FROM deploy_log),
        near AS (SELECT DISTINCT a.run, a.line_no, a.line FROM n a JOIN n h ON a.run = h.run AND a.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 WHERE regexp_matches(h.line, 'FATAL')),
        f AS (SELECT * FROM near WHERE regexp_matches(line, 'ERROR|FATAL') ORDER BY run, line_no LIMIT 5)
        SELECT row_number() OVER (ORDER BY run, line_no) AS position, run, line_no, line FROM f""",
)
def job_07_surroundings(t):
    numbered = number_rows(deploy_log(t.spread("events")), ["run"], ["pos"], "line_no")
    return PI.error_surroundings(numbered, "run", "line_no", "line", "FATAL", "ERROR|FATAL", 5)


def manifest(t):
    files, responses = upload_files(t.documents, t.labels)
    responses = files.select("doc_id", "path").join(responses, "doc_id").drop("doc_id")
    return PF.registration_manifest(files.drop("doc_id"), responses, "path", "content", "storage", "status")


@query(
    "job_08_registration_manifest",
    """SELECT '/upload/' || source || '/' || d.doc_id || '.nc' AS path, d.doc_id || '.nc' AS file_name,
         '{"description":"NetCDF file upload.","directoryLabel":"data/netcdf","categories":["Data"],"restrict":"false","storageIdentifier":"s3://bucket:'
         || d.doc_id || '","fileName":"' || d.doc_id || '.nc","mimeType":"application/x-netcdf","checksum":{"@type":"SHA-1","@value":"' || sha1(text) || '"}}' AS record
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND toxic = 0""",
)
def job_08(t):
    return manifest(t)[0]


@query(
    "job_08_refused_uploads",
    """SELECT '/upload/' || source || '/' || d.doc_id || '.nc' AS path, CASE WHEN quality IS NULL OR quality = 0 THEN 'missing' ELSE 'error' END AS reason
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality = 0 OR toxic = 1""",
)
def job_08_refused(t):
    return manifest(t)[1]


@query(
    "job_08_registered_folder",
    """WITH f AS (SELECT doc_id // 50 AS k, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)
       SELECT k || '.nc' AS file_name, CASE WHEN k % 3 = 0 THEN NULL ELSE
         '{"description":"NetCDF file upload.","directoryLabel":"data/netcdf","categories":["Data"],"restrict":"false","storageIdentifier":"s3://bucket:'
         || k || '","fileName":"' || k || '.nc","mimeType":"application/x-netcdf","checksum":{"@type":"SHA-1","@value":"' || sha1(content) || '"}}' END AS record,
         CASE WHEN k % 3 = 0 THEN 'missing' END AS reason FROM f""",
)
def job_08_folder(t):
    """Files of 50 documents each; the upload of every third file gave no storage identifier."""
    folder = rotated(t.documents, "doc_id", 50, "doc_id", F.col("text"), scratch_path(t.spark, "upload"))
    key, name = (lambda c: F.regexp_extract(c, "rotation=([0-9]+)", 1)), F.concat(F.regexp_extract("path", "rotation=([0-9]+)", 1), F.lit(".nc"))
    listed = file_inventory(t.spark, folder, "*.txt").select("path", key("path").alias("k"))
    storage = F.when(F.col("k").cast("int") % 3 == 0, "null").otherwise(F.concat(F.lit("s3://bucket:"), "k"))
    responses = listed.select("path", storage.alias("storage"), F.lit("OK").alias("status"))
    good, refused = PF.register_folder(t.spark, folder, responses, "*.txt", name=name)
    return good.select("file_name", "record", F.lit(None).cast("string").alias("reason")).unionByName(refused.select(name.alias("file_name"), F.lit(None).cast("string").alias("record"), "reason"))


@query(
    "job_09_download_plan",
    f"""WITH {ANCHORS}, e AS (
      SELECT page_id, i, CASE WHEN i % 3 = 2 THEN 'folder' ELSE 'file' END AS kind,
        CASE WHEN i % 3 = 2 THEN '/api/datasets/' || page_id || '/dirindex/?folder=dir%20' || i ELSE '/api/access/datafile/' || (page_id * 1000 + i) END AS target,
        'base/' || CASE WHEN i % 3 = 2 THEN 'dir ' || i ELSE regexp_replace(label, '[^A-Za-z0-9._-]', '', 'g') END AS path FROM link_lines)
    SELECT page_id, kind, target, path, CASE WHEN page_id % 5 = 0 THEN 'skip' ELSE 'fetch' END AS action FROM e
    WHERE NOT (kind = 'file' AND page_id % 4 = 1 AND page_id % 2 = 1)""",
)
def job_09(t):
    entries = PF.listing_entries(link_lines(t.pages), "page_id", "line", F.lit("base"))
    files = entries.where("kind = 'file'")
    recorded, present = files.where("page_id % 4 = 1"), files.where("page_id % 2 = 1")
    statuses = entries.select("target", F.when(F.col("page_id") % 5 == 0, 403).otherwise(200).alias("status"))
    plan = PF.download_plan(entries, recorded, present, statuses, "target", ignore_forbidden=True)
    return plan.select("page_id", "kind", "target", "path", "action")


@query(
    "job_09_listing_tree",
    """SELECT '/api/access/datafile/' || c_custkey AS target,
         replace(r_name, '_', ' ') || '/' || replace(n_name, '_', ' ') || '/' || regexp_replace(c_name, '[^A-Za-z0-9._-]', '', 'g') || '.txt' AS path
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def job_09_tree(t):
    return PF.listing_tree(folder_indexes(t.region, t.nation, t.customer), "folder", "line")


@query("job_10_rows_to_metadata", f"WITH {FLAT_FIELDS} SELECT CAST(row_key AS VARCHAR) AS row_key, type_name, subfield, value FROM flat")
def job_10(t):
    path = scratch_path(t.spark, "sheet")
    dataset_rows(t.part).write.csv(path, header=True, quote='"', escape='"')
    documents = build_metadata(read_dataset_rows(t.spark, path), "row_key", CONTACT)
    return flatten_metadata(documents, "row_key", "document").select("row_key", "type_name", "subfield", "value")
