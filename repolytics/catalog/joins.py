"""Registered queries: joins and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lines_of
from ..operators import joins as J
from ..operators import sets as S
from ..operators.logs import classify
from ..operators.trees import expand_tree
from ..session import materialize
from ..sources.shapes import catalog, folder_edges, index_fields, launch_options
from .registry import query
from .snippets import LAUNCH_OPTIONS, LINES, SHIPPED_PAIRS


@query(
    "join_01_related_distinct",
    """SELECT DISTINCT p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
)
def join_01(t):
    return J.related_distinct(t.orders, t.lineitem, t.part, ("o_orderkey", "l_orderkey"), ("l_partkey", "p_partkey"), ["p_brand"])


@query(
    "join_02_with_parent",
    "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def join_02(t):
    return J.with_parent(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "join_02_with_children",
    "SELECT o_orderkey, l_partkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
)
def join_02_children(t):
    child = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    return J.with_children(t.orders.select("o_orderkey"), child, "o_orderkey")


COVERAGE_SQL = f"""WITH {SHIPPED_PAIRS}, blocks AS (
  SELECT DISTINCT n_regionkey AS template_id, p_brand AS block FROM pairs JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS parent_name, template_id, block, CASE WHEN first_ship < TIMESTAMP '1995-02-01' THEN 'ENABLED' ELSE 'MISSING' END AS status
FROM nation JOIN blocks ON template_id = n_regionkey LEFT JOIN pairs ON s_nationkey = n_nationkey AND p_brand = block"""


@query("join_03_coverage_matrix", COVERAGE_SQL)
def join_03(t):
    c = catalog(t, "1995-02-01")
    m = J.coverage_matrix(c["parents"], c["blocks"], c["enabled"], "template_id", "parent_id", "block")
    return m.select("parent_name", "template_id", "block", "status")


def level_tables(t):
    """Fields of a template: the segments met in its region; overrides where a nation has rich customers."""
    parents = t.nation.select(F.col("n_regionkey").alias("template_id"), F.col("n_nationkey").alias("parent_id"), F.col("n_name").alias("parent_name"))
    per_pair = materialize(
        t.customer.groupBy(F.col("c_nationkey").alias("parent_id"), F.col("c_mktsegment").alias("field")).agg(
            F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9500).alias("rich")
        )
    )
    fields = per_pair.join(parents.select("template_id", "parent_id"), "parent_id").select("template_id", "field").distinct()
    overrides = per_pair.where(F.col("rich") > 0).select(
        "parent_id", "field", (F.col("n") % 2 == 0).alias("include"), F.lit(True).alias("required")
    )
    return parents, fields, overrides


LEVELS_SQL = """WITH per_pair AS (
  SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 9500) AS rich FROM customer GROUP BY ALL),
fields AS (SELECT DISTINCT n_regionkey AS template_id, c_mktsegment AS field FROM per_pair JOIN nation ON c_nationkey = n_nationkey),
overrides AS (SELECT c_nationkey, c_mktsegment, n % 2 = 0 AS include, true AS required FROM per_pair WHERE rich > 0)
SELECT n_name AS parent_name, field, coalesce(include, true) AS include, coalesce(required, false) AS required
FROM nation JOIN fields ON template_id = n_regionkey LEFT JOIN overrides ON c_nationkey = n_nationkey AND c_mktsegment = field"""


@query("join_04_effective_levels", LEVELS_SQL)
def join_04(t):
    levels = J.effective_levels(*level_tables(t), "template_id", "parent_id", "field")
    return levels.select("parent_name", "field", "include", "required")


DENIED_SQL = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"


def denied(t):
    return t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("user_id"))


@query("join_05_exclude_denied", f"SELECT event_id, user_id FROM events WHERE user_id NOT IN {DENIED_SQL}")
def join_05(t):
    return J.exclude_denied(t.events, denied(t), "user_id")[0].select("event_id", "user_id")


@query("join_05_dropped_count", f"SELECT count(*) AS dropped FROM events WHERE user_id IN {DENIED_SQL}")
def join_05_dropped(t):
    return J.exclude_denied(t.events, denied(t), "user_id")[1]


@query(
    "join_06_pending",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
)
def join_06(t):
    manifest, present = t.labels.where("quality = 1"), t.labels.where("toxic = 0")
    return J.pending(t.documents.select("doc_id"), manifest, present, "doc_id")


MISSING_SQL = f"""WITH {LAUNCH_OPTIONS}
SELECT DISTINCT opt AS option, okey AS key FROM listing
WHERE listing = 'PROMO' AND opt IS NOT NULL AND NOT regexp_matches(okey, 'gizmo')
  AND okey NOT IN (SELECT okey FROM listing WHERE listing = 'SMALL' AND okey IS NOT NULL)"""


@query("join_07_missing_options", MISSING_SQL)
def join_07(t):
    listing = launch_options(t.part)
    a = J.options_of(listing.where(F.col("listing") == "PROMO"), "raw")
    b = J.options_of(listing.where(F.col("listing") == "SMALL"), "raw")
    return J.missing_options(a, b, "gizmo").select("option", "key").distinct()


@query(
    "join_08_retype",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey IN
         (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7) THEN 'text/vtt' ELSE o_orderstatus END AS kind FROM orders""",
)
def join_08(t):
    files = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("kind"))
    label = F.concat("l_returnflag", F.when(F.col("l_linenumber") == 7, ".vtt").otherwise(".txt"))
    names = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), label.alias("label"))
    return J.retype(files, names, "o_orderkey", "kind", "label", "O", "R%.vtt", "text/vtt")


@query(
    "join_09_rekey",
    """WITH e AS (SELECT ascii(event_type) AS type_id, (props->>'$.k') LIKE '1%' AS hit FROM events)
       SELECT count(*) FILTER (type_id = 99 AND hit) AS before, count(*) FILTER (type_id = 99 AND hit) AS moved,
              count(*) FILTER ((type_id = 99 OR type_id = 118) AND hit) AS after FROM e""",
)
def join_09(t):
    hit = F.get_json_object("props", "$.k").like("1%")
    events = t.events.select(F.ascii("event_type").alias("type_id"), hit.alias("hit"))
    click, view = F.ascii(F.lit("click")), F.ascii(F.lit("view"))
    moved = J.rekey(events.withColumn("old", F.col("type_id")), "type_id", click, view, F.col("hit"))
    return moved.agg(
        F.count_if((F.col("old") == click) & F.col("hit")).alias("before"),
        F.count_if("moved").alias("moved"),
        F.count_if((F.col("type_id") == view) & F.col("hit")).alias("after"),
    )


@query(
    "join_10_as_of_day",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-16' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
)
def join_10(t):
    return J.as_of(t.orders, "o_orderdate", "1997-06-15", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "join_10_as_of_join",
    """SELECT p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""",
)
def join_10_many(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_ts"))
    return J.as_of_join(left, right, "user_id", "ts", "signup_ts", ["signup_id"]).select("event_id", "signup_id")


# Line families looked for in document text.
TEXT_RULES = [
    ("web", ["https?://", r"www\."]),
    ("mail", [r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+"]),
    ("licence", ["licen[sc]e", "copyright", "permission"]),
    ("secret", ["api[_-]?key", "password", "token", "secret"]),
    ("digits", ["[0-9]{3}"]),
]


@query(
    "join_11_classify",
    f"""WITH {LINES} SELECT lang, class, count(*) AS n FROM (
      SELECT lang, CASE WHEN regexp_matches(line, '(?i)https?://|www\\.') THEN 'web'
        WHEN regexp_matches(line, '(?i)[a-z0-9._]+@[a-z0-9]+\\.[a-z]+') THEN 'mail'
        WHEN regexp_matches(line, '(?i)licen[sc]e|copyright|permission') THEN 'licence'
        WHEN regexp_matches(line, '(?i)api[_-]?key|password|token|secret') THEN 'secret'
        WHEN regexp_matches(line, '[0-9]{{3}}') THEN 'digits' ELSE 'other' END AS class FROM lines) GROUP BY ALL""",
)
def join_11(t):
    rows = t.spread("documents").select("lang", F.explode(lines_of("text")).alias("line"))
    return rows.groupBy("lang", classify("line", TEXT_RULES).alias("class")).agg(F.count("*").alias("n"))


@query(
    "join_12_reconcile",
    """SELECT coalesce(a.k, b.k) AS key, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b,
         CASE WHEN b.k IS NULL THEN 'a_only' WHEN a.k IS NULL THEN 'b_only' ELSE 'both' END AS status
       FROM (SELECT o_orderkey AS k, count(*) AS n_a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) a
       FULL JOIN (SELECT l_orderkey AS k, count(*) AS n_b FROM lineitem GROUP BY 1) b ON a.k = b.k""",
)
def join_12(t):
    a = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    return J.reconcile(a, t.lineitem.select(F.col("l_orderkey").alias("key")), "key")


@query(
    "join_13_verify_checksums",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'unverified' WHEN 2 THEN 'mismatch' ELSE 'match' END AS status FROM documents""",
)
def join_13(t):
    files = t.documents.select("doc_id", F.sha2("text", 256).alias("actual"))
    k = F.col("doc_id") % 4
    expected = t.documents.where(k != 0).select(
        "doc_id",
        F.when(k == 1, "REPLACE_WITH_OFFICIAL_SHA256")
        .when(k == 2, F.sha2(F.concat("text", F.lit("x")), 256))
        .otherwise(F.sha2("text", 256))
        .alias("wanted"),
    )
    return J.verify_checksums(files, expected, "doc_id", "actual", "wanted").select("doc_id", "status")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "join_14_missing_required",
    """SELECT o_custkey, p AS o_orderpriority FROM (SELECT c_custkey AS o_custkey FROM customer),
         (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS p)
       WHERE (o_custkey, p) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders)""",
)
def join_14(t):
    return J.missing_required(t.orders, "o_orderpriority", PRIORITIES, "o_custkey", t.customer.select(F.col("c_custkey").alias("o_custkey")))


@query(
    "join_14_all_present",
    "SELECT count(DISTINCT p_type) FILTER (p_type IN ('PROMO', 'SMALL', 'GIANT')) = 3 AS complete FROM part",
)
def join_14_all(t):
    return J.has_all_required(t.part, "p_type", ["PROMO", "SMALL", "GIANT"])


@query(
    "join_15_expand_tree",
    """WITH RECURSIVE edges AS (
         SELECT 'root' AS parent, 'r' || r_regionkey AS child, r_name AS name FROM region
         UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_name FROM nation
         UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name FROM customer),
       walk AS (
         SELECT child AS node, 1 AS depth, name AS path FROM edges WHERE parent = 'root'
         UNION ALL SELECT e.child, w.depth + 1, w.path || '/' || e.name FROM walk w JOIN edges e ON e.parent = w.node)
       SELECT node, depth, path FROM walk""",
)
def join_15(t):
    return expand_tree(folder_edges(t.region, t.nation, t.customer), "root")


@query(
    "join_16_table_diff",
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, sum(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 ELSE -1 END) AS n
         FROM orders GROUP BY ALL)
       SELECT o_orderstatus, o_orderpriority, CASE WHEN n > 0 THEN 'old' ELSE 'new' END AS side, CAST(abs(n) AS BIGINT) AS copies FROM c WHERE n <> 0""",
)
def join_16(t):
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    halves = [t.orders.where(half).select("o_orderstatus", "o_orderpriority") for half in (early, ~early)]
    return J.table_diff(*halves)


@query(
    "join_17_apply_changes",
    """WITH up AS (SELECT c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'CHANGED' END AS content FROM customer WHERE c_custkey % 5 = 0
         UNION ALL SELECT s_name, 'NEW' FROM supplier)
       SELECT name, content FROM up WHERE content <> ''
       UNION ALL SELECT c_name, c_mktsegment FROM customer
       WHERE c_name NOT IN (SELECT name FROM up) AND c_name <> 'Customer#000000004' AND NOT c_name LIKE '%7'""",
)
def join_17(t):
    settings = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("content"))
    changed = t.customer.where("c_custkey % 5 = 0").select(
        F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise("CHANGED").alias("content")
    )
    new = t.supplier.select(F.col("s_name").alias("name"), F.lit("NEW").alias("content"))
    return J.apply_changes(settings, "name", "content", changed.unionByName(new), ["Customer#000000004"], ["%7"])


@query(
    "set_01_union_distinct",
    """SELECT o_custkey AS c_custkey FROM orders
       UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3""",
)
def set_01(t):
    return S.union_distinct(t.orders.select(F.col("o_custkey").alias("c_custkey")), t.customer.where("c_nationkey = 3").select("c_custkey"))


def order_checks(t):
    orders = {"status known": ("error", ~F.col("o_orderstatus").isin("O", "F", "P")), "price below 1000": ("warning", F.col("o_totalprice") < 1000)}
    lines = {
        "discount high": ("warning", F.col("l_discount") > 0.09),
        "quantity positive": ("error", F.col("l_quantity") <= 0),
        "line number in order": ("error", F.col("l_linenumber") > 6),
    }
    return [S.checks(t.orders, orders), S.checks(t.lineitem, lines)]


CHECKS_SQL = """checks AS (
  SELECT 'status known' AS "check", 'error' AS severity, count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) AS offending FROM orders
  UNION ALL SELECT 'price below 1000', 'warning', count(*) FILTER (o_totalprice < 1000) FROM orders
  UNION ALL SELECT 'discount high', 'warning', count(*) FILTER (l_discount > 0.09) FROM lineitem
  UNION ALL SELECT 'quantity positive', 'error', count(*) FILTER (l_quantity <= 0) FROM lineitem
  UNION ALL SELECT 'line number in order', 'error', count(*) FILTER (l_linenumber > 6) FROM lineitem)"""


@query("set_02_validation_report", f'WITH {CHECKS_SQL} SELECT "check", severity, offending FROM checks WHERE offending > 0')
def set_02(t):
    return S.validation_report(order_checks(t))


@query(
    "set_02_validation_summary",
    f"""WITH {CHECKS_SQL} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
        count(*) FILTER (severity = 'error') = 0 AS passed FROM checks WHERE offending > 0""",
)
def set_02_summary(t):
    return S.validation_summary(S.validation_report(order_checks(t)))


@query(
    "set_03_merge_fields",
    """WITH f AS (SELECT replace(p_name, ' ', '_') AS name, 'text_general' AS type, min(p_size) % 2 = 0 AS multi_valued FROM part GROUP BY ALL),
       w AS (SELECT DISTINCT lower(c_mktsegment) AS name, 'string' AS type, false AS multi_valued FROM customer
             UNION ALL SELECT name, 'string', false FROM f WHERE name LIKE 'red%')
       SELECT name, type, multi_valued OR name IN ('red_bolt', 'blue_gear', 'hot_ring') AS multi_valued FROM f
       UNION ALL SELECT name, type, multi_valued FROM w WHERE name NOT IN (SELECT name FROM f)""",
)
def set_03(t):
    schema = index_fields(t.part).select("name", "type", "multi_valued")
    segments = t.customer.select(F.lower("c_mktsegment").alias("name")).distinct()
    wanted = segments.unionByName(schema.where(F.col("name").like("red%")).select("name")).select(
        "name", F.lit("string").alias("type"), F.lit(False).alias("multi_valued")
    )
    return S.merge_fields(schema, wanted, ["red_bolt", "blue_gear", "hot_ring"])
