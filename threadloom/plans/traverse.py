"""Traversal queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import traverse as T
from ..sources.checkpoints import settled
from ..sources.graph import GraphStore, current, live
from .prelude import EDGES, NODES, NOTES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


PAIRS = """
of AS (SELECT id, CASE WHEN type = 'project' THEN id ELSE project_id END AS root FROM nodes),
cross_edges AS (SELECT a.root AS f, b.root AS t, e.type FROM cur e JOIN of a ON a.id = e.source_id JOIN of b ON b.id = e.target_id WHERE e.type IN ('depends_on', 'affects', 'contradicts') AND a.root <> b.root),
pairs AS (SELECT least(f, t) AS root_a, greatest(f, t) AS root_b, count(*) FILTER (type <> 'contradicts') AS dependency, 0::BIGINT AS containment, 0::BIGINT AS evolution, count(*) FILTER (type = 'contradicts') AS conflict, 0::BIGINT AS loose, count(*) AS total,
  count(*) FILTER (type = 'depends_on' AND t = least(f, t)) AS to_a, count(*) FILTER (type = 'depends_on' AND t = greatest(f, t)) AS to_b FROM cross_edges GROUP BY 1, 2)
"""


@query("f06_root_relatedness", sql("SELECT root_a, root_b, dependency, containment, evolution, conflict, loose, total, CASE WHEN greatest(to_a, to_b) = 0 THEN NULL WHEN to_a >= to_b THEN root_a ELSE root_b END AS parent, greatest(to_a, to_b) AS parent_edges FROM pairs", NODES, EDGES, ctes=PAIRS))
def relatedness(g: GraphStore) -> DataFrame:
    members = g.work().select("id", "type", "project_id").unionByName(g.entities().filter("id LIKE 's%'").select("id", "type", "project_id"))
    return T.root_relatedness(members, current(g.supplies()))[0]


@query("f06_standalone_roots", sql("SELECT id FROM nodes WHERE type = 'project' AND id NOT IN (SELECT root_a FROM pairs UNION SELECT root_b FROM pairs)", NODES, EDGES, ctes=PAIRS))
def standalone(g: GraphStore) -> DataFrame:
    return T.root_relatedness(g.nodes().select("id", "type", "project_id"), current(g.supplies()))[1]


@query("f01_top_root", sql("SELECT id, coalesce(project_id, id) AS top, (project_id IS NOT NULL)::BIGINT AS up_levels FROM nodes WHERE type = 'project'", NODES))
def top_root(g: GraphStore) -> DataFrame:
    return T.top_roots(g.roots())


@query("f02_project_closure", sql("SELECT r.id AS root, n.type, count(*) AS n FROM live n JOIN (SELECT id, coalesce(project_id, id) AS top FROM nodes WHERE type = 'project') p ON p.id = n.project_id JOIN nodes r ON r.id = p.top GROUP BY 1, 2", NODES))
def project_closure(g: GraphStore) -> DataFrame:
    """Members of each top project and of all projects below it."""
    tops = T.top_roots(g.roots()).select(F.col("id").alias("project_id"), F.col("top").alias("root"))
    return live(g.nodes()).join(tops, "project_id").groupBy("root", "type").agg(F.count("*").alias("n"))


@query(
    "f03_scope_chain",
    sql(
        "SELECT id, arg_max(scope, depth) AS scope FROM chain GROUP BY id",
        NODES,
        EDGES,
        ctes="""over_ AS (SELECT source_id, min(target_id) AS target_id FROM containment GROUP BY 1),
chain AS (SELECT id, id AS at, label AS scope, 1 AS depth FROM nodes WHERE type IN ('task', 'entity', 'project') UNION ALL SELECT c.id, e.target_id, p.label || ' > ' || c.scope, depth + 1 FROM chain c JOIN over_ e ON e.source_id = c.at JOIN nodes p ON p.id = e.target_id WHERE depth < 8)""",
        recursive=True,
    ),
)
def scope_chain(g: GraphStore) -> DataFrame:
    """Labels from the topmost container down to each task, entity and project, eight at most."""
    blocks = g.roots().unionByName(g.entities()).unionByName(g.work().filter("type = 'task'")).select("id", "label")
    return T.scope_chains(blocks, current(g.containment()), g.roots().unionByName(g.entities()).select("id", "label"))


@query(
    "f05_root_list",
    sql(
        "SELECT p.id, p.project_id AS parent, (SELECT count(*) FROM live x WHERE x.project_id = p.id) AS blocks, (SELECT string_agg(o || ':' || total, ' ' ORDER BY total DESC, o) FROM (SELECT CASE WHEN root_a = p.id THEN root_b ELSE root_a END AS o, total FROM pairs WHERE p.id IN (root_a, root_b) ORDER BY total DESC, o LIMIT 4)) AS entangled FROM nodes p WHERE p.type = 'project'",
        NODES,
        EDGES,
        ctes=PAIRS,
    ),
)
def root_list(g: GraphStore) -> DataFrame:
    """Projects with their size and their four most related roots."""
    from ..operators.reads import top_in_group

    pairs = relatedness(g).select("root_a", "root_b", "total")
    sides = pairs.select(F.col("root_a").alias("id"), F.col("root_b").alias("o"), "total").unionByName(pairs.select(F.col("root_b").alias("id"), F.col("root_a").alias("o"), "total"))
    best = top_in_group(sides, ["id"], [F.desc("total"), F.col("o")], 4).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "o", "total").alias("x")))).alias("xs"))
    size = live(g.nodes()).filter("project_id IS NOT NULL").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("blocks"))
    return g.roots().select("id", F.col("project_id").alias("parent")).join(size, "id", "left").join(best, "id", "left").select("id", "parent", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.array_join(F.col("xs.x"), " ").alias("entangled"))


def spine(g: GraphStore) -> DataFrame:
    return g.prompts().unionByName(g.evidence())


def stored_spine(g: GraphStore) -> DataFrame:
    """The spine as a stored table, for queries that read it more than once."""
    return settled(spine(g))


def starts(g: GraphStore) -> DataFrame:
    """Orders whose key is divisible by 50, the focal nodes of the thread queries."""
    return g.table("orders").filter("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("start"))


WALKS = """
starts AS (SELECT 'o' || o_orderkey AS start FROM orders WHERE o_orderkey % 50 = 0),
up AS (SELECT start, start AS id, 0 AS depth FROM starts UNION SELECT u.start, s.target_id, u.depth + 1 FROM up u JOIN spine s ON s.source_id = u.id),
down AS (SELECT start, start AS id, 0 AS depth FROM starts UNION SELECT u.start, s.source_id, u.depth + 1 FROM down u JOIN spine s ON s.target_id = u.id),
ups AS (SELECT start, id, -min(depth) AS depth FROM up GROUP BY 1, 2),
members AS (SELECT * FROM ups UNION ALL SELECT start, id, min(depth) FROM down d WHERE NOT EXISTS (SELECT 1 FROM ups u WHERE u.start = d.start AND u.id = d.id) GROUP BY 1, 2),
inner_edges AS (SELECT a.start, s.source_id, s.target_id FROM spine s JOIN members a ON a.id = s.source_id JOIN members b ON b.id = s.target_id AND a.start = b.start)
"""


@query("f11_causal_order", "SELECT 't' || o_custkey AS chain, 'o' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def causal_order(g: GraphStore) -> DataFrame:
    members = g.table("orders").select(F.concat(F.lit("t"), "o_custkey").alias("chain"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return T.causal_order(members, spine(g))


@query("f13_components", "SELECT 'o' || o_orderkey AS id, min('o' || o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def component(g: GraphStore) -> DataFrame:
    return T.components(spine(g))


@query(
    "f14_mechanical_chains",
    sql(
        "SELECT min(id) AS chain, count(*) AS members, arg_max(id, o) AS terminal, arg_max(type, o) AS terminal_type FROM (SELECT n.id, n.type, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY x.o_orderdate, x.o_orderkey) AS o FROM orders x JOIN nodes n ON n.id = 'o' || x.o_orderkey) GROUP BY o_custkey HAVING count(*) > 1 AND arg_max(type, o) IN ('dead_end', 'decision')",
        NODES,
    ),
)
def mechanical_chains(g: GraphStore) -> DataFrame:
    return T.chains(g.work(), stored_spine(g))


@query(
    "f15_challenges",
    sql(
        "SELECT id, challenger, min(hops)::BIGINT AS hops FROM (SELECT target_id AS id, source_id AS challenger, 1 AS hops FROM cur WHERE type = 'contradicts' UNION ALL SELECT e.source_id, c.source_id, 2 FROM (SELECT * FROM cur WHERE type = 'depends_on') e JOIN cur c ON c.target_id = e.target_id AND c.type = 'contradicts') WHERE id LIKE 's%' OR id IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 50 = 0) GROUP BY 1, 2",
        EDGES,
    ),
)
def challenges(g: GraphStore) -> DataFrame:
    """Challenges of all suppliers and of a list of recalled orders."""
    recalled = g.table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(g.table("orders").filter("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    e = current(g.supplies()).filter("type IN ('contradicts', 'depends_on')")
    asked = e.filter("type = 'contradicts'").unionByName(e.filter("type = 'depends_on'").join(recalled.withColumnRenamed("id", "source_id"), "source_id", "left_semi"))
    return T.challenges(asked, recalled)


@query("f17_stale_closure", sql("SELECT DISTINCT e.source_id AS id FROM evidence e JOIN nodes n ON n.id = e.target_id WHERE n.updated_at > e.created_at", NODES, EDGES))
def stale_closure(g: GraphStore) -> DataFrame:
    changed = g.work().select(F.col("id").alias("target_id"), "updated_at")
    return g.evidence().join(changed, "target_id").filter("updated_at > created_at").select(F.col("source_id").alias("id")).distinct()


@query("f19_context_tiers", sql("SELECT id, project_id, CASE WHEN project_id = 'src1' THEN 0 ELSE 2 END + CASE WHEN type IN ('decision', 'constraint', 'insight') THEN 0 ELSE 1 END AS tier FROM notes", NOTES))
def context_tiers(g: GraphStore) -> DataFrame:
    tier = F.when(F.col("project_id") == "src1", 0).otherwise(2) + F.when(F.col("type").isin("decision", "constraint", "insight"), 0).otherwise(1)
    return g.notes().select("id", "project_id", tier.alias("tier"))


@query(
    "f20_item_context",
    sql("SELECT id, other, side, place FROM (SELECT id, other, side, row_number() OVER (PARTITION BY id, side ORDER BY other) AS place FROM (SELECT target_id AS id, source_id AS other, 'effect' AS side FROM spine UNION ALL SELECT source_id, target_id, 'cause' FROM spine)) WHERE place <= CASE side WHEN 'effect' THEN 4 ELSE 3 END", EDGES),
)
def item_context(g: GraphStore) -> DataFrame:
    """Up to four effects and three causes of every node."""
    from pyspark.sql.window import Window

    s = spine(g).select("source_id", "target_id").distinct()
    sides = s.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("effect").alias("side")).unionByName(s.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit("cause").alias("side")))
    placed = sides.withColumn("place", F.row_number().over(Window.partitionBy("id", "side").orderBy("other")).cast("bigint"))
    return placed.filter(F.col("place") <= F.when(F.col("side") == "effect", 4).otherwise(3))
