"""Threads, trees and chains as they are shown, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import threads as S
from ..operators import traverse as T
from ..sources.graph import GraphStore, current
from .prelude import EDGES, NODES, sql
from .traverse import WALKS, starts, stored_spine

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


def grounding(g: GraphStore) -> DataFrame:
    """affects edges stand for evidence, since the tables have none that supports."""
    return current(g.supplies()).filter("type = 'affects'")


MEMBERS = (
    WALKS
    + """, backs AS (SELECT source_id AS id, count(*) AS n FROM cur WHERE type = 'affects' GROUP BY 1),
m AS (SELECT m.start, m.id, m.depth, coalesce(b.n, 0) AS backed_by, o.id IS NULL AS is_origin, f.id IS NULL AS is_leaf, l.label, l.type, l.essence, l.access_count, l.created_at
  FROM members m LEFT JOIN backs b ON b.id = m.id LEFT JOIN live l ON l.id = m.id
  LEFT JOIN (SELECT DISTINCT start, source_id AS id FROM inner_edges) o ON o.start = m.start AND o.id = m.id
  LEFT JOIN (SELECT DISTINCT start, target_id AS id FROM inner_edges) f ON f.start = m.start AND f.id = m.id)"""
)


@query("f07_thread_walk", sql("SELECT start, id, depth::BIGINT AS depth, CASE WHEN depth = 0 THEN 'focal' WHEN is_origin THEN 'origin' WHEN is_leaf THEN 'leaf' ELSE 'step' END AS role, backed_by FROM m", NODES, EDGES, ctes=MEMBERS, recursive=True))
def thread_walk(g: GraphStore) -> DataFrame:
    return S.grounds(T.thread(stored_spine(g), starts(g)), grounding(g))


@query(
    "f08_sign",
    sql(
        """SELECT f.start, lineage, leads_to, greatest(coalesce(l.n, 0) - 5, 0)::BIGINT AS more_leaves, backed_by::BIGINT AS backed_by, forked, l.n IS NULL AS terminal, arc, coalesce(l.first, c.last) AS conclusion
FROM (SELECT start, sum(backed_by) AS backed_by, count(*) FILTER (is_leaf) > 1 AS forked FROM m GROUP BY 1 HAVING count(*) > 1) f
JOIN (SELECT start, string_agg(label, ' > ' ORDER BY k) AS lineage, CASE WHEN count(*) > 1 THEN string_agg(essence, '  →  ' ORDER BY k) END AS arc, arg_max(essence, k) AS last FROM came WHERE k = 1 OR k > n - 7 GROUP BY 1) c ON c.start = f.start
LEFT JOIN (SELECT start, string_agg(label, ' > ' ORDER BY k) AS leads_to, max(n) AS n, arg_min(essence, k) AS first FROM ranked WHERE k <= 5 GROUP BY 1) l ON l.start = f.start""",
        NODES,
        EDGES,
        ctes=MEMBERS
        + """, came AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, id) AS k, count(*) OVER (PARTITION BY start) AS n FROM m WHERE label IS NOT NULL AND (id = start OR is_origin OR (depth <= 0 AND type IN ('dead_end', 'decision')))),
nx AS (SELECT *, count(*) FILTER (depth = 1) OVER (PARTITION BY start) AS hops FROM m WHERE label IS NOT NULL AND id <> start AND (depth = 1 OR is_leaf)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY CASE type WHEN 'dead_end' THEN 5 WHEN 'decision' THEN 4 ELSE 1 END DESC, access_count DESC, id) AS k, count(*) OVER (PARTITION BY start) AS n FROM nx WHERE depth = 1 OR hops = 0)""",
        recursive=True,
    ),
)
def sign(g: GraphStore) -> DataFrame:
    """A signpost for each start that is on a thread."""
    return S.signs(T.members(stored_spine(g), starts(g)), g.work(), grounding(g))


@query(
    "f09_full_thread",
    sql(
        "SELECT start, id, label, type, role, backed_by, place FROM (SELECT *, CASE WHEN depth = 0 THEN 'focal' WHEN is_origin THEN 'origin' WHEN is_leaf THEN 'leaf' ELSE 'step' END AS role, row_number() OVER (PARTITION BY start ORDER BY depth, created_at, id) AS place, count(*) OVER (PARTITION BY start) AS n FROM m WHERE label IS NOT NULL) WHERE n > 1",
        NODES,
        EDGES,
        ctes=MEMBERS,
        recursive=True,
    ),
)
def full_thread(g: GraphStore) -> DataFrame:
    return S.whole_threads(T.thread(stored_spine(g), starts(g)), g.work(), grounding(g))


@query(
    "f10_linked_threads",
    sql(
        "SELECT start, thread, via, thread AS handle, place FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY w DESC, thread) AS place FROM (SELECT m.start, e.target_id AS thread, max(CASE e.type WHEN 'contradicts' THEN 4 ELSE 2 END) AS w, arg_max(e.type, CASE e.type WHEN 'contradicts' THEN 4 ELSE 2 END) AS via FROM members m JOIN cur e ON e.source_id = m.id WHERE e.type IN ('contradicts', 'affects') GROUP BY 1, 2)) WHERE place <= 12",
        EDGES,
        ctes=WALKS,
        recursive=True,
    ),
)
def linked_threads(g: GraphStore) -> DataFrame:
    """The twelve strongest ties of each start's thread."""
    s = stored_spine(g)
    comps = T.components(s)
    return S.linked_threads(T.members(s, starts(g), comps=comps).select("start", "id"), s, current(g.supplies()), g.work().unionByName(g.entities()), comps=comps)


@query(
    "f12_bounded_chain",
    sql(
        "SELECT b.start, b.id, b.depth::BIGINT AS depth, v.via, l.essence AS gist, b.depth = 0 AS is_focal FROM bc b JOIN nodes l ON l.id = b.id LEFT JOIN via v ON v.start = b.start AND v.id = b.id",
        NODES,
        EDGES,
        ctes=WALKS
        + """, bc AS (SELECT start, id, depth FROM members WHERE depth BETWEEN -7 AND 5),
typed AS (SELECT source_id, target_id, type FROM prompts UNION ALL SELECT source_id, target_id, type FROM evidence),
via AS (SELECT start, id, min(type) AS via FROM (SELECT b.start, b.id, e.type FROM bc b JOIN typed e ON e.target_id = b.id JOIN bc p ON p.start = b.start AND p.id = e.source_id AND p.depth = b.depth + 1 WHERE b.depth < 0
  UNION ALL SELECT b.start, b.id, e.type FROM bc b JOIN typed e ON e.source_id = b.id JOIN bc p ON p.start = b.start AND p.id = e.target_id AND p.depth = b.depth - 1 WHERE b.depth > 0) GROUP BY 1, 2)""",
        recursive=True,
    ),
)
def bounded_chain(g: GraphStore) -> DataFrame:
    """Seven steps up and five down from each start."""
    return S.bounded_chain(stored_spine(g), starts(g), g.work())


@query(
    "f04_tree",
    sql(
        "SELECT t.root, t.id, t.parent, t.depth, t.role, coalesce(c.n, 0) AS children FROM (SELECT id AS root, id, NULL AS parent, 0::BIGINT AS depth, 'project' AS role FROM live WHERE type = 'project' UNION ALL SELECT p.id, n.id, p.id, 1, CASE WHEN n.type IN ('dead_end', 'decision') THEN n.type WHEN n.type = 'task' AND n.work_status = 'in_progress' THEN 'active_task' ELSE 'child' END FROM live p JOIN live n ON n.project_id = p.id WHERE p.type = 'project' AND n.type <> 'project') t LEFT JOIN (SELECT project_id AS id, count(*) AS n FROM nodes GROUP BY 1) c ON c.id = t.id",
        NODES,
    ),
)
def tree(g: GraphStore) -> DataFrame:
    return S.tree(g.nodes())


CHAINS = """line AS (SELECT n.id, n.label, n.type, n.essence, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY x.o_orderdate, x.o_orderkey) AS place FROM orders x JOIN nodes n ON n.id = 'o' || x.o_orderkey),
whole AS (SELECT o_custkey, min(id) AS chain, count(*) AS members, arg_max(id, place) AS terminal, arg_max(type, place) AS terminal_type, arg_max(label, place) AS l, arg_min(essence, place) AS first, arg_max(essence, place) AS last FROM line GROUP BY 1 HAVING count(*) > 1 AND arg_max(type, place) IN ('dead_end', 'decision'))"""


@query("f14_chain_texts", sql("SELECT chain, members, terminal, terminal_type, split_part(l, '_', 1) || '_chain_arc' AS label, first || ' → ' || last AS essence, last AS conclusion FROM whole", NODES, ctes=CHAINS))
def chain_texts(g: GraphStore) -> DataFrame:
    """Chains with label, essence and conclusion."""
    return S.chain_texts(g.work(), stored_spine(g))[0]


@query("f14_chain_members", sql("SELECT chain, place, id, label, type FROM line JOIN whole USING (o_custkey)", NODES, ctes=CHAINS))
def chain_member_rows(g: GraphStore) -> DataFrame:
    """Members of each chain, causes first; their types in this order are its arc."""
    return S.chain_texts(g.work(), stored_spine(g))[1]


@query(
    "f16_chain_members",
    "SELECT 't' || o_custkey AS chain, 'o' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM (SELECT *, bool_or(o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey) AS by_edge FROM orders WHERE o_orderkey % 10 <> 0) WHERE o_orderkey % 3 = 0 OR NOT by_edge",
)
def chain_members(g: GraphStore) -> DataFrame:
    """Every order names its customer's chain; one order in three has an edge to it as well, and those go before."""
    o = g.table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("t"), "o_custkey").alias("chain"), "o_orderkey")
    edges = o.filter("o_orderkey % 3 = 0").select(F.col("id").alias("source_id"), F.col("chain").alias("target_id"))
    return S.members_in_order(g.work().join(o.select("id", F.col("chain").alias("chain_id")), "id"), edges, stored_spine(g))
