"""SQL fragments shared by the oracle formulations: the shapes of ``sources.shapes`` in SQL."""

LINES = r"""
lines AS (
  SELECT doc_id, lang, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no
  FROM (SELECT doc_id, lang, source, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS ls FROM documents)
)"""

FAILURE_LOG = """
failure_log AS (
  SELECT 'doi:10.5072/' || (props->>'$.k') AS pid, '/dataset/' || event_id AS uri, event_type AS method,
         CAST(user_id AS VARCHAR) AS ip, ts AS time, user_id, event_id
  FROM events
), kept AS (
  SELECT * FROM failure_log
  WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
)"""

SHIPPED_PAIRS = """
pairs AS (
  SELECT s_nationkey, p_brand, min(l_shipdate) AS first_ship
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL
)"""

LAUNCH_OPTIONS = """
listing AS (
  SELECT p_partkey AS pos, p_type AS listing,
    CASE p_partkey % 7
      WHEN 0 THEN '' WHEN 1 THEN 'JDK versions: ' || p_size
      WHEN 2 THEN '-XX:' || replace(p_name, ' ', '.') || '  '
      WHEN 3 THEN '-D' || replace(p_name, ' ', '.') || '.' || p_brand || '=https://host/' || p_size
      ELSE '-D' || replace(p_name, ' ', '.') || '.' || p_brand || '=' || p_size || '   --> since ' || p_partkey END AS raw,
    CASE p_partkey % 7
      WHEN 0 THEN NULL WHEN 1 THEN NULL
      WHEN 2 THEN '-XX:' || replace(p_name, ' ', '.')
      WHEN 3 THEN '-D' || replace(p_name, ' ', '.') || '.' || p_brand || '=https://host/' || p_size
      ELSE '-D' || replace(p_name, ' ', '.') || '.' || p_brand || '=' || p_size END AS opt,
    CASE p_partkey % 7
      WHEN 0 THEN NULL WHEN 1 THEN NULL
      WHEN 2 THEN '-XX:' || replace(p_name, ' ', '.')
      ELSE replace(p_name, ' ', '.') || '.' || p_brand END AS okey
  FROM part
)"""

DEPLOY_LOG = """
deploy_log AS (
  SELECT user_id AS run, event_id AS pos,
    CASE WHEN event_type = 'error' AND k = 0 THEN 'FATAL: connection refused'
         WHEN event_type = 'error' AND k < 60 THEN 'PER01000: ERROR: relation t' || k || ' already exists'
         WHEN event_type = 'error' THEN 'ERROR: column displayoncreate does not exist'
         WHEN event_type = 'purchase' AND k < 3 THEN 'remote failure: Command deploy failed'
         WHEN event_type = 'signup' AND k < 30 THEN 'Exception: application with name app is already registered'
         WHEN event_type = 'click' AND k = 7 THEN 'Failed to load default.policy'
         ELSE 'INFO: step ' || k END AS line
  FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)
)"""

ANCHORS = r"""
anchors AS (
  SELECT page_id, unnest(tags) AS tag, unnest(range(0, len(tags))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>') AS tags FROM pages)
), link_lines AS (
  SELECT page_id, i + 1 AS line_no, i, regexp_extract(tag, '>([^<]*)</a>', 1) AS label FROM anchors
)"""

DAILY = """
daily AS (
  SELECT user_id AS series, date_trunc('day', ts) AS ts, count(*) AS doc_count FROM events GROUP BY ALL
)"""

FILES = """
files AS (
  SELECT l_orderkey AS o_orderkey,
         l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name,
         CAST(l_quantity AS BIGINT) AS bytes, l_partkey, l_returnflag,
         CASE WHEN l_returnflag = 'R' THEN 'text/plain; charset=US-ASCII' ELSE 'application/dbf' END AS encoding
  FROM lineitem
)"""

DESCRIPTIONS = FILES + """,
entries AS (
  SELECT o_orderkey, name, CAST(bytes AS VARCHAR) AS size,
    '{"@id":"' || name || '","contentSize":"' || bytes || '","contentUrl":"https://data.example.org/api/access/datafile/'
      || l_partkey || '","encodingFormat":"' || encoding || '","md5":"' || md5(name) || '","name":"' || name || '"}' AS entry
  FROM files WHERE o_orderkey IN (SELECT o_orderkey FROM orders)
), descriptions AS (
  SELECT o_orderkey, CAST(0 AS BIGINT) AS place, '{"@type":"sc:Dataset","creator":[{"@type":"Person","name":"Customer, ' || o_custkey || '"}],"distribution":[' AS fragment
  FROM orders
  UNION ALL
  SELECT o_orderkey, row_number() OVER w, CASE WHEN row_number() OVER w > 1 THEN ',' ELSE '' END || entry
  FROM entries WINDOW w AS (PARTITION BY o_orderkey ORDER BY name, size, entry)
  UNION ALL
  SELECT o.o_orderkey, 1 + (SELECT count(*) FROM files f WHERE f.o_orderkey = o.o_orderkey), '],"keywords":["' || o_orderpriority
    || '"],"license":"http://creativecommons.org/publicdomain/zero/1.0","name":"Order ' || o.o_orderkey
    || '","url":"https://doi.org/10.5072/' || o.o_orderkey || '","version":"1.0"}'
  FROM orders o
)"""

DOCUMENTS = FILES + """,
numbered AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY o_orderkey ORDER BY name, CAST(bytes AS VARCHAR), l_partkey, encoding) - 1) // 1000 AS INTEGER) AS part FROM files
), parts AS (
  SELECT o_orderkey, part, string_agg('{"@id":"' || name || '","contentSize":"' || bytes || '","contentUrl":"https://data.example.org/api/access/datafile/'
      || l_partkey || '","encodingFormat":"' || encoding || '","md5":"' || md5(name) || '","name":"' || name || '"}', ','
      ORDER BY name, CAST(bytes AS VARCHAR), encoding) AS distribution
  FROM numbered GROUP BY o_orderkey, part
), lists AS (
  SELECT o_orderkey, string_agg(distribution, ',' ORDER BY part) AS distribution FROM parts GROUP BY o_orderkey
), documents_of_orders AS (
  SELECT o.o_orderkey, 0 AS part,
    '{"@type":"sc:Dataset","creator":[{"@type":"Person","name":"Customer, ' || o_custkey || '"}],"distribution":['
    || coalesce(distribution, '') || '],"keywords":["' || o_orderpriority
    || '"],"license":"http://creativecommons.org/publicdomain/zero/1.0","name":"Order ' || o.o_orderkey
    || '","url":"https://doi.org/10.5072/' || o.o_orderkey || '","version":"1.0"}' AS document
  FROM orders o LEFT JOIN lists l ON l.o_orderkey = o.o_orderkey
)"""

FLAT_FIELDS = """
dataset_rows AS (
  SELECT p_partkey, p_name, p_type, p_brand,
    CASE WHEN p_partkey % 2 = 0 THEN '<a href="https://data.example.org/source/' || p_partkey || '">' || p_type || '</a>' END AS src
  FROM part
), flat AS (
  SELECT p_partkey AS row_key, 'title' AS type_name, 'primitive' AS type_class, 0 AS idx, CAST(NULL AS VARCHAR) AS subfield, p_name AS value FROM dataset_rows
  UNION ALL SELECT p_partkey, 'author', 'compound', 0, 'authorName', p_brand FROM dataset_rows
  UNION ALL SELECT p_partkey, 'datasetContact', 'compound', 0, 'datasetContactEmail', 'support@example.org' FROM dataset_rows
  UNION ALL SELECT p_partkey, 'datasetContact', 'compound', 0, 'datasetContactName', 'Support' FROM dataset_rows
  UNION ALL SELECT p_partkey, 'dsDescription', 'compound', 0, 'dsDescriptionValue', p_type FROM dataset_rows
  UNION ALL SELECT p_partkey, 'subject', 'controlledVocabulary', 0, NULL, 'Other' FROM dataset_rows
  UNION ALL SELECT p_partkey, 'originOfSources', 'primitive', 0, NULL, src FROM dataset_rows WHERE src IS NOT NULL
)"""
