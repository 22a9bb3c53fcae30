"""The graph projection in the SQL that checks the queries."""

NODES = """
orders_n AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
nodes AS (
  SELECT 'r' || r_regionkey AS id, lower(r_name) AS label, 'project' AS type, 'active' AS status, 'permanent' AS ttl, NULL::VARCHAR AS project_id, r_name AS essence, []::VARCHAR[] AS concepts,
    TIMESTAMP '2020-01-01' AS created_at, TIMESTAMP '2020-01-01' AS updated_at, 0::BIGINT AS access_count, 3::BIGINT AS quality, NULL::VARCHAR AS work_status, NULL::VARCHAR AS priority FROM region
  UNION ALL SELECT 'n' || n_nationkey, lower(n_name), 'project', 'active', 'permanent', 'r' || n_regionkey, n_name, [], TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-01', 0, 3, NULL, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, lower(c_name), 'entity', 'active', 'project', 'n' || c_nationkey, c_name, [lower(c_mktsegment)], TIMESTAMP '2021-01-01', TIMESTAMP '2021-01-01' + to_days((c_custkey % 1000)::INT), c_custkey % 7, 1 + c_custkey % 5, NULL, NULL FROM customer
  UNION ALL SELECT 's' || s_suppkey, lower(s_name), 'entity', 'active', 'project', 'n' || s_nationkey, s_name, [], TIMESTAMP '2021-01-01', TIMESTAMP '2021-01-01', s_suppkey % 7, 1 + s_suppkey % 5, NULL, NULL FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'part_' || p_partkey, 'artifact', 'created', '1week', NULL, p_name, list_concat(string_split(lower(p_name), ' '), [lower(p_type), lower(p_brand)]), TIMESTAMP '2022-01-01' + to_days((p_partkey % 365)::INT), TIMESTAMP '2022-01-01' + to_days((p_partkey % 365)::INT), p_partkey % 11, 1 + p_partkey % 5, NULL, NULL FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'order_' || o_orderkey, (['task', 'decision', 'fact', 'dead_end'])[(o_orderkey % 4 + 1)::INT], CASE WHEN o_orderkey % 10 = 0 THEN 'archived' WHEN o_orderkey % 10 = 1 THEN 'pending' ELSE 'active' END,
    (['session', '1hr', '24hr', '1week', 'project', 'permanent'])[(o_orderkey % 6 + 1)::INT], 'n' || c_nationkey, o_orderpriority, [lower(o_orderpriority)], o_orderdate, o_orderdate + to_days((o_orderkey % 200)::INT), o_orderkey % 5, 1 + o_orderkey % 5,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'done' END, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'high' WHEN left(o_orderpriority, 1) = '3' THEN 'medium' ELSE 'low' END FROM orders_n),
live AS (SELECT * FROM nodes WHERE status <> 'archived')
"""

NOTES = """
notes AS (
  SELECT 'd' || doc_id AS id, 'doc_' || doc_id AS label, (['fact', 'insight', 'decision', 'constraint', 'question', 'preference'])[(doc_id % 6 + 1)::INT] AS type, 'active' AS status,
    (['session', '1hr', '24hr', '1week', 'project', 'permanent'])[(doc_id % 6 + 1)::INT] AS ttl, source AS project_id, text AS essence, [lang] AS concepts, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at,
    doc_id % 5 AS access_count, 1 + doc_id % 5 AS quality, doc_id FROM documents),
normal AS (SELECT doc_id, 'd' || doc_id AS id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n]+', ' ', 'g')) AS norm FROM documents),
revisions AS (SELECT id AS source_id, cause AS target_id FROM (SELECT id, lag(id) OVER (PARTITION BY norm ORDER BY doc_id) AS cause FROM normal) WHERE cause IS NOT NULL)
"""

EDGES = """
containment AS (
  SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'part_of' AS type, 'active' AS status, TIMESTAMP '2020-01-01' AS created_at, NULL::TIMESTAMP AS valid_to FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'part_of', 'active', TIMESTAMP '2020-01-01', NULL FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'part_of', 'active', TIMESTAMP '2020-01-01', NULL FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'part_of', 'active', TIMESTAMP '2020-01-01', NULL FROM orders),
prompts AS (SELECT 'o' || o_orderkey AS source_id, 'o' || cause AS target_id, 'prompted_by' AS type, 'active' AS status, o_orderdate AS created_at, NULL::TIMESTAMP AS valid_to
  FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cause FROM orders) WHERE cause IS NOT NULL),
evidence AS (SELECT DISTINCT 'o' || o_orderkey AS source_id, 'o' || cause AS target_id, 'based_on' AS type, 'active' AS status, o_orderdate AS created_at, NULL::TIMESTAMP AS valid_to
  FROM (SELECT o_orderkey, o_orderdate, first_value(o_orderkey) OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate, o_orderkey) AS cause
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey) WHERE cause <> o_orderkey),
supplies AS (SELECT 'o' || l_orderkey AS source_id, 's' || l_suppkey AS target_id, CASE l_returnflag WHEN 'N' THEN 'depends_on' WHEN 'A' THEN 'affects' ELSE 'contradicts' END AS type, 'active' AS status, l_shipdate AS created_at,
  CASE WHEN l_linestatus = 'F' AND l_quantity < 5 THEN l_shipdate + INTERVAL 30 DAY END AS valid_to FROM lineitem),
edges AS (SELECT * FROM containment UNION ALL SELECT * FROM prompts UNION ALL SELECT * FROM evidence UNION ALL SELECT * FROM supplies),
cur AS (SELECT * FROM edges WHERE valid_to IS NULL AND status = 'active'),
spine AS (SELECT source_id, target_id FROM prompts UNION SELECT source_id, target_id FROM evidence)
"""


def sql(body: str, *parts: str, ctes: str = "", recursive: bool = False) -> str:
    """body under the chosen parts of the prelude and further CTEs."""
    chosen = [*parts, *([ctes] if ctes else [])]
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(chosen) + "\n" if chosen else "") + body
