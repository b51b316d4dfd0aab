"""Registered queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lines_of
from ..operators import aggregates as A
from ..operators.filters import not_builtin
from ..operators.fragments import whole_texts
from ..operators.joins import exclude_denied
from ..operators.logs import run_verdict
from ..session import materialize
from ..sources.shapes import deploy_log, description_tables, failure_log, usage_report
from .joins import denied
from .registry import query
from .snippets import DEPLOY_LOG, FAILURE_LOG, FILES, LINES


@query(
    "agg_01_count_in_month",
    "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' AND o_orderdate < TIMESTAMP '1999-01-01'",
)
def agg_01(t):
    return A.count_in_month(t.orders, "o_orderdate", "1998-12")


@query("agg_02_monthly_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def agg_02(t):
    return A.monthly_counts(t.orders, "o_orderdate")


def kept_log(t):
    deny = denied(t).select(F.col("user_id").cast("string").alias("ip"))
    return exclude_denied(failure_log(t.events), deny, "ip")[0]


@query("agg_03_hits", f"WITH {FAILURE_LOG} SELECT pid, count(*) AS hits FROM kept GROUP BY pid")
def agg_03(t):
    return A.hits(kept_log(t), "pid")


DETAILS_SQL = f"""WITH {FAILURE_LOG}
SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY time, event_id) AS position,
       method || ' ' || uri || ' from ' || ip || ' at ' || strftime(time, '%Y-%m-%d %H:%M:%S.%f') AS line FROM kept"""


@query("agg_04_details", DETAILS_SQL)
def agg_04(t):
    at = F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat("method", F.lit(" "), "uri", F.lit(" from "), "ip", F.lit(" at "), at)
    return A.details(kept_log(t), "pid", ["time", "pos"], line)


@query(
    "agg_05_count_by_rules",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS published,
       count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS large_open FROM orders""",
)
def agg_05(t):
    return A.count_by_rules(
        t.orders,
        {
            "total": F.lit(True),
            "published": F.col("o_orderstatus") == "F",
            "large_open": (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000),
        },
    )


@query(
    "agg_06_usage_totals",
    """SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS n
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""",
)
def agg_06(t):
    return A.usage_totals(usage_report(t.orders, t.lineitem), "performance", "R")


@query(
    "agg_07_empty_split",
    """SELECT count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS with_entries,
       count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS without_entries FROM orders""",
)
def agg_07(t):
    return A.empty_split(usage_report(t.orders, t.lineitem).where("part = 0"), F.get("performance", F.lit(0))["instance"])


def consistency_rules():
    db = {"dataset": F.col("o_orderstatus") == "O", "collection": F.col("o_orderpriority") == "1-URGENT"}
    index = {
        "dataset": (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1),
        "collection": (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 2),
    }
    return db, index


CONSISTENCY_SQL = """WITH c AS (
  SELECT 'dataset' AS kind, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS db_count,
         (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 1) AS idx
  UNION ALL SELECT 'collection', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'),
         (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2))
SELECT kind, db_count, db_count - idx AS discrepancy,
  CASE WHEN kind = 'dataset' THEN CASE WHEN db_count < idx THEN 'EXCELLENT' WHEN db_count > idx THEN 'DISCREPANCY' ELSE 'PERFECT' END
       ELSE CASE WHEN db_count = idx THEN 'PERFECT' WHEN db_count - idx = 1 THEN 'MINOR' ELSE 'DISCREPANCY' END END AS verdict
FROM c"""


@query("agg_08_consistency", CONSISTENCY_SQL)
def agg_08(t):
    return A.consistency(t.orders, t.lineitem, *consistency_rules())


@query(
    "agg_09_duplicate_keys",
    "SELECT sha256(text) AS sha, doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents QUALIFY n > 1",
)
def agg_09(t):
    # texts are read and hashed once; both uses of the digests read the small written table
    keyed = materialize(t.spread("documents").select(F.sha2("text", 256).alias("sha"), "doc_id"))
    return A.duplicate_keys(keyed, "sha", "doc_id")


@query(
    "agg_10_pattern_counts",
    f"""WITH {LINES} SELECT count(*) FILTER (regexp_matches(line, 'https?://')) AS web, count(*) FILTER (regexp_matches(line, '[0-9]{{4}}')) AS digits,
        count(*) FILTER (regexp_matches(line, '^$')) AS blank FROM lines""",
)
def agg_10(t):
    rows = t.spread("documents").select(F.explode(lines_of("text")).alias("line"))
    return A.pattern_counts(rows, "line", {"web": "https?://", "digits": "[0-9]{4}", "blank": "^$"})


@query(
    "agg_11_field_coverage",
    """WITH j AS (SELECT d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       SELECT 'lang' AS field, count(lang) AS records FROM j UNION ALL SELECT 'quality', count(quality) FROM j UNION ALL SELECT 'toxic', count(toxic) FROM j""",
)
def agg_11(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return A.field_coverage(joined, ["lang", "quality", "toxic"])


@query(
    "agg_12_joined_names",
    """SELECT p_type, CAST(0 AS INTEGER) AS part, string_agg(p_brand, ',' ORDER BY p_brand) AS names
       FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')) GROUP BY p_type""",
)
def agg_12(t):
    listed = A.joined_names(not_builtin(t.part, "p_brand", ["Brand#1", "Brand#2"]), ["p_type"], "p_brand")
    return whole_texts(listed, ["p_type"], "names").select("p_type", F.lit(0).alias("part"), "names")


@query(
    "agg_13_run_verdict",
    f"""WITH {DEPLOY_LOG}, c AS (
      SELECT *, regexp_matches(line, '(?i)error|exception|failed') AS err, regexp_matches(line, '(?i)FATAL:|connection refused') AS fat,
        line LIKE '%does not exist%' AS mig, line LIKE '%already exists%' OR line LIKE '%already registered%' AS ben FROM deploy_log),
    w AS (SELECT *, min(CASE WHEN line LIKE '%already registered%' THEN pos END) OVER (PARTITION BY run) AS flag FROM c),
    g AS (SELECT run, bool_or(fat) AS fatal, bool_or(mig) AS has_migration, bool_or(line LIKE '%default.policy%') AS has_policy,
        count(*) FILTER (err) AS error_lines,
        count(*) FILTER (err AND NOT mig AND NOT ben AND NOT (line LIKE '%Command deploy failed%' AND flag IS NOT NULL AND flag < pos)) AS bad
      FROM w GROUP BY run)
    SELECT run, fatal, has_migration, has_policy, error_lines, CASE WHEN fatal OR bad > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM g""",
)
def agg_13(t):
    return run_verdict(deploy_log(t.spread("events")), ["run"], "pos", "line")


def month_counts(t, years_back):
    month = F.date_format(F.add_months("o_orderdate", 12 * years_back), "yyyy-MM").alias("month")
    return t.orders.groupBy(month).agg(F.count("*").alias("n"))


@query(
    "agg_14_compare_baseline",
    """WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS now FROM orders GROUP BY 1),
         b AS (SELECT strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m') AS month, count(*) AS base FROM orders GROUP BY 1)
       SELECT month, now, base, CASE WHEN base IS NULL THEN 'now_only' WHEN now IS NULL THEN 'base_only' ELSE 'both' END AS status,
         now >= base * 90 // 100 AS floor_ok,
         CASE WHEN now >= base * 95 // 100 AND now <= base * 120 // 100 THEN 'ok' WHEN now < base * 80 // 100 THEN 'warning' ELSE 'info' END AS range,
         now > base * 5 // 100 AS started, now * 100 // base AS percent_done, trunc((now - base) * 1000.0 / base) / 10.0 AS growth
       FROM a FULL JOIN b USING (month)""",
)
def agg_14(t):
    """Orders of every month against those of the same month a year before."""
    return A.compare_baseline(month_counts(t, 0), month_counts(t, 1), "month", "n")


@query(
    "agg_15_latest",
    """SELECT user_id, event_id, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def agg_15(t):
    return A.latest_by(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "agg_16_distribution_summary",
    f'WITH {FILES} SELECT encoding AS "encodingFormat", count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM files GROUP BY ALL',
)
def agg_16(t):
    return A.distribution_summary(description_tables(t.orders, t.lineitem)[1])
