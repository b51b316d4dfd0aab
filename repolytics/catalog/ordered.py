"""Registered queries: order-sensitive operators and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import version_key, version_lt
from ..operators import ordering as O
from ..operators import sequence as S
from ..operators.aggregates import hits
from ..session import materialize
from ..sources.readers import lines
from ..sources.shapes import daily_counts, state_events
from .aggregates import kept_log
from .registry import query
from .snippets import DAILY, FAILURE_LOG, LINES


@query(
    "win_01_later_duplicates",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1",
)
def win_01(t):
    keyed = materialize(t.spread("documents").select("doc_id", F.sha2("text", 256).alias("sha")))
    return S.later_duplicates(keyed, "sha", ["doc_id"]).select("doc_id")


CONTEXT_SQL = f"""WITH {LINES}, h AS (
  SELECT doc_id, line_no, line, max(CASE WHEN regexp_matches(line, '[0-9]{{3}}') THEN 1 ELSE 0 END) OVER
    (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM h WHERE near = 1"""


@query("win_02_context_of_text", CONTEXT_SQL)
def win_02(t):
    found = S.context_of_text(F.col("text"), "[0-9]{3}")
    return t.spread("documents").select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


@query("win_02_context_lines", CONTEXT_SQL)
def win_02_lines(t):
    return S.context_lines(lines(t.spread("documents"), "doc_id", "text"), "doc_id", "line_no", F.col("line").rlike("[0-9]{3}"))


@query(
    "win_02_first_context_lines",
    f"""WITH {LINES}, h AS (
  SELECT doc_id, line_no, line, max(CASE WHEN regexp_matches(line, '[0-9]{{3}}') THEN 1 ELSE 0 END) OVER
    (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM h WHERE near = 1 AND regexp_matches(line, 'e') ORDER BY doc_id, line_no LIMIT 5""",
)
def win_02_first(t):
    # the report shows the first five of the filtered context lines
    return win_02(t).where(F.col("line").rlike("e")).orderBy("doc_id", "line_no").limit(5).select("doc_id", "line_no")


STABLE_SQL = f"""WITH {DAILY}, l AS (
  SELECT *, lag(doc_count) OVER (PARTITION BY series ORDER BY ts) AS prev FROM daily),
g AS (SELECT *, sum(CASE WHEN doc_count IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts) AS island FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY series, island ORDER BY ts) - 1 AS run FROM g)
SELECT series, strftime(ts, '%Y-%m-%d') AS stable_day, doc_count AS stable_value FROM r WHERE run >= 2
QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts) = 1"""


def stable_days(df):
    return df.select("series", F.date_format("stable_ts", "yyyy-MM-dd").alias("stable_day"), "stable_value")


@query("win_03_stable_at", STABLE_SQL)
def win_03(t):
    return stable_days(S.stable_at(daily_counts(t.events), ["series"], "ts", "doc_count", 2))


@query(
    "win_03_stable_since_increase",
    f"""WITH {DAILY}, l AS (SELECT *, lag(doc_count) OVER (PARTITION BY series ORDER BY ts) AS prev FROM daily),
    c AS (SELECT *, sum(CASE WHEN doc_count > prev THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts) AS grown FROM l),
    r AS (SELECT *, sum(CASE WHEN doc_count = prev THEN 1 ELSE 0 END) OVER (PARTITION BY series, grown ORDER BY ts) AS run FROM c)
    SELECT series, strftime(ts, '%Y-%m-%d') AS stable_day, doc_count AS stable_value FROM r WHERE run >= 3
    QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts) = 1""",
)
def win_03_increase(t):
    return stable_days(
        S.stable_at(daily_counts(t.events), ["series"], "ts", "doc_count", 3, reset="increase")
    )


STALL_SQL = f"""WITH {DAILY}, l AS (SELECT *, lag(doc_count) OVER (PARTITION BY series ORDER BY ts) AS prev FROM daily),
m AS (SELECT *, max(CASE WHEN doc_count > prev THEN ts END) OVER (PARTITION BY series ORDER BY ts) AS inc FROM l)
SELECT series, strftime(ts, '%Y-%m-%d') AS day, date_diff('second', inc, ts) AS idle_seconds FROM m WHERE date_diff('second', inc, ts) > 172800"""


@query("win_04_stalls", STALL_SQL)
def win_04(t):
    found = S.stalls(daily_counts(t.events), ["series"], "ts", "doc_count", 172800)
    return found.select("series", F.date_format("ts", "yyyy-MM-dd").alias("day"), "idle_seconds")


@query(
    "win_05_after_flag",
    """SELECT event_id, user_id FROM events e WHERE event_type = 'purchase'
       AND event_id > (SELECT min(event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id)""",
)
def win_05(t):
    kind = F.col("event_type")
    return S.after_flag(t.events, ["user_id"], "event_id", kind == "signup", kind == "purchase").select("event_id", "user_id")


@query(
    "win_06_contiguous_months",
    """WITH m AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS k FROM orders),
       r AS (SELECT *, k - row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS island, count(*) OVER (PARTITION BY o_custkey) AS total,
                    min(k) OVER (PARTITION BY o_custkey) AS k0 FROM m),
       p AS (SELECT o_custkey, k0, max(total) AS total, count(*) AS n FROM r WHERE island = k0 - 1 GROUP BY ALL)
       SELECT o_custkey, printf('%04d-%02d', k0 // 12, k0 % 12 + 1) AS first_month,
              printf('%04d-%02d', (k0 + n - 1) // 12, (k0 + n - 1) % 12 + 1) AS last_month, n AS months, total > n AS has_gap FROM p""",
)
def win_06(t):
    return S.contiguous_months(t.orders, ["o_custkey"], "o_orderdate")


STATE_SQL = """WITH s AS (SELECT user_id AS key, CAST(props->>'$.k' AS INTEGER) % 5 AS type, event_type AS action, ts, event_id FROM events)
SELECT key, type, action AS state, count(*) OVER (PARTITION BY key, type) AS n_actions FROM s
QUALIFY row_number() OVER (PARTITION BY key, type ORDER BY ts DESC, event_id DESC) = 1"""


@query("win_07_current_state", STATE_SQL)
def win_07(t):
    return S.current_state(state_events(t.events), ["key", "type"], ["ts", "event_id"], "action")


@query("ord_01_by_name", "SELECT row_number() OVER (ORDER BY lower(p_name), p_partkey) AS position, p_partkey FROM part")
def ord_01(t):
    return O.positioned_ci(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey").select("position", "p_partkey")


@query(
    "ord_02_rank_hits",
    f"""WITH {FAILURE_LOG}, h AS (SELECT pid, count(*) AS hits, min(ROW(time, event_id)) AS first_seen FROM kept GROUP BY pid)
        SELECT row_number() OVER (ORDER BY hits DESC, first_seen, pid) AS rank, pid, hits FROM h""",
)
def ord_02(t):
    return O.rank_hits(hits(kept_log(t), "pid", "time", "pos"), "pid").select("rank", "pid", "hits")


@query(
    "ord_03_hidden_sort",
    "SELECT row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS position, o_orderkey FROM orders",
)
def ord_03(t):
    slim = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return O.order_hidden(slim, [F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey"])


@query(
    "ord_04_tail_then_filter",
    "SELECT event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE event_type = 'error'",
)
def ord_04(t):
    return O.tail_then(t.events.select("event_id", "ts", "event_type"), 100, F.col("event_type") == "error", "ts", "event_id").select("event_id")


@query(
    "ord_04_filter_then_tail",
    "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5",
)
def ord_04_then(t):
    return O.then_tail(t.events.select("event_id", "ts", "event_type"), F.col("event_type") == "error", 5, "ts", "event_id").select("event_id")


@query(
    "ord_05_version_order",
    """WITH v AS (SELECT DISTINCT replace(p_brand, 'Brand#', '') || '.' || p_size AS version FROM part),
       k AS (SELECT version, CAST(split_part(version, '.', 1) AS INTEGER) AS a, CAST(split_part(version, '.', 2) AS INTEGER) AS b FROM v)
       SELECT row_number() OVER (ORDER BY a, b) AS position, version, (a, b) < (6, 9) AS before_6_9 FROM k""",
)
def ord_05(t):
    version = F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("."), "p_size")
    versions = t.part.select(version.alias("version")).distinct()
    ordered = O.with_position(versions, version_key("version"))
    return ordered.withColumn("before_6_9", version_lt("version", F.lit("6.9")))
