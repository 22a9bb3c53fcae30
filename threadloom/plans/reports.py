"""Reports over all projects and sessions at once, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import reports as P
from ..sources.graph import GraphStore, at, current, live
from .prelude import EDGES, NODES, NOTES, sql
from .traverse import PAIRS, relatedness

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


def key_of(id_: str = "id") -> Column:
    return F.substring(id_, 2, 20).cast("bigint")


def relabelled(g: GraphStore) -> DataFrame:
    """Live nodes, where every ninth order is labelled as a nation's that need not be its own."""
    nodes = live(g.nodes()).select("id", "label", "type", "project_id")
    odd = F.when(F.col("id").startswith("o") & (key_of() % 9 == 0), F.concat(F.lit("n"), key_of() % 25))
    named = g.roots().select(F.col("id").alias("as_of"), F.col("label").alias("prefix"))
    return nodes.withColumn("as_of", odd).join(named, "as_of", "left").select("id", F.concat_ws("_", "prefix", "label").alias("label"), "type", "project_id")


_SCOPES = """
named AS (SELECT l.id, l.type, l.project_id, concat_ws('_', r.label, l.label) AS label FROM live l LEFT JOIN (SELECT id, label FROM nodes WHERE type = 'project') r ON l.id LIKE 'o%' AND substr(l.id, 2)::BIGINT % 9 = 0 AND r.id = 'n' || (substr(l.id, 2)::BIGINT % 25)),
root AS (SELECT id, label FROM named WHERE type = 'project'),
scope AS (SELECT p.id AS root, n.id, n.type FROM named n JOIN root p ON n.id = p.id OR n.project_id = p.id OR starts_with(n.label, p.label || '_')),
home AS (SELECT id, CASE WHEN type = 'project' THEN id ELSE project_id END AS root FROM named WHERE type = 'project' OR project_id IN (SELECT id FROM root)),
ends AS (SELECT source_id AS id, target_id AS far FROM cur UNION ALL SELECT target_id, source_id FROM cur),
near AS (SELECT DISTINCT s.root, h.root AS other FROM ends e JOIN scope s ON s.id = e.id JOIN home h ON h.id = e.far WHERE s.root <> h.root),
subs AS (SELECT DISTINCT target_id AS root, source_id AS other FROM cur WHERE type = 'part_of' AND source_id <> target_id AND source_id IN (SELECT id FROM root) AND target_id IN (SELECT id FROM root)),
places AS (SELECT root, other, 'sub_root' AS place FROM subs UNION ALL SELECT root, other, 'entangled' FROM (SELECT * FROM near EXCEPT SELECT * FROM subs)),
kinds AS (SELECT unnest(['task', 'dead_end']) AS kind)"""


@query(
    "b04_disclosed_counts",
    sql(
        """SELECT root.id AS root, kind, 'own' AS place, NULL::VARCHAR AS other, count(s.id) AS n FROM root CROSS JOIN kinds LEFT JOIN scope s ON s.root = root.id AND s.type = kind GROUP BY ALL
UNION ALL SELECT p.root, h.type, p.place, p.other, count(*) FROM places p JOIN scope h ON h.root = p.other AND h.id <> p.other JOIN kinds ON kind = h.type WHERE NOT EXISTS (SELECT 1 FROM scope s WHERE s.root = p.root AND s.id = h.id) GROUP BY ALL""",
        NODES,
        EDGES,
        ctes=_SCOPES,
    ),
)
def disclosed_counts(g: GraphStore) -> DataFrame:
    """Tasks and dead ends of every project, of its sub-roots and of roots entangled with it."""
    return P.disclosed(relabelled(g), current(g.edges()), ["task", "dead_end"])


@query(
    "f05_root_tree",
    sql(
        """SELECT p.id, p.label, p.essence AS description, (SELECT count(*) FROM live x WHERE x.project_id = p.id) AS blocks, up.label AS parent_root,
  coalesce((SELECT string_agg(c.label, '|' ORDER BY c.label) FROM nodes c WHERE c.type = 'project' AND c.project_id = p.id), '') AS child_roots,
  coalesce((SELECT string_agg(label, '|' ORDER BY total DESC, label) FROM (SELECT o.label, total FROM pairs JOIN nodes o ON o.id = CASE WHEN root_a = p.id THEN root_b ELSE root_a END WHERE p.id IN (root_a, root_b) ORDER BY total DESC, o.label LIMIT 4)), '') AS entangled_with
FROM nodes p LEFT JOIN nodes up ON up.id = p.project_id WHERE p.type = 'project'""",
        NODES,
        EDGES,
        ctes=PAIRS,
    ),
)
def root_tree(g: GraphStore) -> DataFrame:
    """Projects as a tree, top ones first, with what they are entangled with."""
    tree = P.root_tree(live(g.nodes()), current(g.containment()), relatedness(g))
    return tree.withColumn("child_roots", F.array_join("child_roots", "|")).withColumn("entangled_with", F.array_join("entangled_with", "|"))


def briefed(g: GraphStore) -> DataFrame:
    """Projects, orders and documents, the documents in the first twenty nations; what rests on evidence or revises is derived."""
    columns = ("id", "label", "type", "project_id", "work_status", "created_at", "updated_at")
    notes = g.notes().withColumn("project_id", F.concat(F.lit("n"), key_of() % 20))
    nodes = live(g.roots().select(*columns, "status").unionByName(g.work().select(*columns, "status")).unionByName(notes.select(*columns, "status")))
    sources = g.evidence().select("source_id").unionByName(g.revisions().select("source_id")).distinct().select(F.col("source_id").alias("id"), F.lit(True).alias("found"))
    return nodes.join(sources, "id", "left").withColumn("derived", F.coalesce("found", F.lit(False))).drop("found")


_BRIEFED = """
all_nodes AS (SELECT id, label, type, project_id, work_status, created_at, updated_at FROM live WHERE type = 'project' OR id LIKE 'o%' UNION ALL SELECT id, label, type, 'n' || (doc_id % 20), NULL, created_at, updated_at FROM notes),
briefed AS (SELECT *, id IN (SELECT source_id FROM evidence UNION ALL SELECT source_id FROM revisions) AS derived FROM all_nodes)"""


@query(
    "e20_briefing",
    sql(
        """SELECT project, section, CASE WHEN most IS NOT NULL THEN place END AS place, id, label, type, created_at, nullif(updated_at, created_at) AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY project, section ORDER BY updated_at DESC, id) AS place FROM (
    SELECT *, 'open_tasks' AS section, NULL AS most FROM known WHERE type = 'task' AND lower(coalesce(work_status, '')) NOT IN ('done', 'completed', 'archived')
    UNION ALL SELECT *, type || 's', NULL FROM known WHERE type IN ('decision', 'constraint')
    UNION ALL SELECT *, 'derived', 5 FROM known WHERE derived
    UNION ALL SELECT *, 'other', 10 FROM known WHERE type NOT IN ('task', 'decision', 'constraint', 'project') AND NOT derived)) WHERE most IS NULL OR place <= most""",
        NODES,
        NOTES,
        EDGES,
        ctes=_BRIEFED
        + """,
short AS (SELECT p.id FROM briefed p WHERE p.type = 'project' AND (SELECT count(*) FROM briefed b WHERE b.project_id = p.id AND b.type <> 'project') < 3),
latest AS (SELECT * FROM briefed ORDER BY updated_at DESC, id LIMIT 15),
known AS (SELECT project_id AS project, b.* FROM briefed b WHERE project_id IS NOT NULL UNION ALL SELECT s.id, l.* FROM short s JOIN latest l ON l.project_id IS DISTINCT FROM s.id)""",
    ),
)
def briefing(g: GraphStore) -> DataFrame:
    """What to know on returning to each project."""
    return P.briefing(briefed(g))


@query(
    "e20_since",
    sql(
        """SELECT 'new' AS section, NULL::BIGINT AS place, id, type AS what, created_at AS at FROM briefed WHERE created_at > TIMESTAMP '2001-06-01'
UNION ALL SELECT 'updated', NULL, id, type, updated_at FROM briefed WHERE updated_at > TIMESTAMP '2001-06-01' AND created_at <= TIMESTAMP '2001-06-01'
UNION ALL (SELECT 'changes', row_number() OVER (ORDER BY ts DESC, event_id DESC), 'c' || user_id, event_type, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE ts > TIMESTAMP '2001-06-01' ORDER BY ts DESC, event_id DESC LIMIT 30)""",
        NODES,
        NOTES,
        EDGES,
        ctes=_BRIEFED,
    ),
)
def since(g: GraphStore) -> DataFrame:
    """What changed after a time, in all projects."""
    history = g.table("events").select(F.concat(F.lit("c"), "user_id").alias("node_id"), F.col("event_type").alias("field"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return P.since(briefed(g), history, at("2001-06-01 00:00:00"))


@query(
    "e13_session_cycles",
    """WITH cycles AS (SELECT o_custkey AS session, o_orderkey AS cycle, floor(o_totalprice * 100)::BIGINT AS billed, floor(o_totalprice)::BIGINT % 60000 AS lag, o_orderstatus = 'P' AS limited, nullif(left(o_orderpriority, 1), '5') AS pass FROM orders),
w AS (SELECT session, CASE l_returnflag WHEN 'N' THEN 'task' WHEN 'A' THEN 'decision' ELSE 'fact' END AS type, l_quantity / 8 AS quality, l_linestatus = 'O' AS created FROM lineitem JOIN cycles ON l_orderkey = cycle),
ran AS (SELECT session, count(*) AS cycles, sum(billed)::BIGINT AS billed, sum(lag)::BIGINT AS lag, max(lag) AS max_lag_ms, count(*) FILTER (limited) AS limit_hits FROM cycles GROUP BY 1),
wrote AS (SELECT session, count(*) FILTER (created) AS created, count(*) FILTER (NOT created) AS updated, count(*) FILTER (created AND quality >= 4) AS related,
  count(*) FILTER (created AND floor(quality + 0.5) <= 1) AS q1, count(*) FILTER (created AND floor(quality + 0.5) = 2) AS q2, count(*) FILTER (created AND floor(quality + 0.5) = 3) AS q3, count(*) FILTER (created AND floor(quality + 0.5) = 4) AS q4, count(*) FILTER (created AND floor(quality + 0.5) = 5) AS q5, count(*) FILTER (created AND floor(quality + 0.5) >= 6) AS q6 FROM w GROUP BY 1),
types AS (SELECT session, string_agg(type || ':' || n, ' ' ORDER BY type) AS types FROM (SELECT session, type, count(*) AS n FROM w WHERE created GROUP BY 1, 2) GROUP BY 1),
limits AS (SELECT session, string_agg(pass || ':' || n, ' ' ORDER BY pass) AS limits FROM (SELECT session, pass, count(*) AS n FROM cycles WHERE limited AND pass IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
told AS (SELECT user_id AS session, count(*) AS recalls, sum(floor(value)::BIGINT)::BIGINT AS injected, sum(CASE WHEN event_type = 'error' THEN floor(value)::BIGINT ELSE 0 END)::BIGINT AS crossed FROM events WHERE user_id IS NOT NULL GROUP BY 1),
m AS (SELECT * REPLACE (coalesce(billed, 0) AS billed, coalesce(created, 0) AS created, coalesce(updated, 0) AS updated, coalesce(related, 0) AS related, coalesce(injected, 0) AS injected, coalesce(crossed, 0) AS crossed) FROM ran LEFT JOIN wrote USING (session) LEFT JOIN types USING (session) LEFT JOIN limits USING (session) FULL JOIN told USING (session))
SELECT session, coalesce(cycles, 0) AS cycles, coalesce(recalls, 0) AS recalls, created, updated, billed, CASE WHEN created > 0 THEN floor(billed / created + 0.5)::BIGINT ELSE 0 END AS cost_per_block, coalesce(limit_hits, 0) AS limit_hits, coalesce(types, '') AS types,
  coalesce(q1, 0) AS q1, coalesce(q2, 0) AS q2, coalesce(q3, 0) AS q3, coalesce(q4, 0) AS q4, coalesce(q5, 0) AS q5, coalesce(q6, 0) AS q6,
  CASE WHEN created > 0 THEN floor(related / created * 100 + 0.5)::BIGINT ELSE 0 END AS density_pct, CASE WHEN created + updated > 0 THEN floor(updated / (created + updated) * 100 + 0.5)::BIGINT ELSE 0 END AS update_pct,
  CASE WHEN cycles > 0 THEN floor(lag / cycles + 0.5)::BIGINT ELSE 0 END AS avg_lag_ms, coalesce(max_lag_ms, 0) AS max_lag_ms, coalesce(limits, '') AS limits, injected, crossed, CASE WHEN injected > 0 THEN floor(crossed / injected * 100 + 0.5)::BIGINT ELSE 0 END AS pollution_pct FROM m""",
)
def session_cycles(g: GraphStore) -> DataFrame:
    """A customer's orders are the cycles of a session, their lines what was written, the user's events its recalls."""
    price = F.col("o_totalprice")
    cycles = g.table("orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("cycle"), F.floor(price * 100).alias("billed"), (F.floor(price) % 60000).alias("lag_ms"), (F.col("o_orderstatus") == "P").alias("limited"), F.nullif(F.substring("o_orderpriority", 1, 1), F.lit("5")).alias("limit_pass"))
    kind = F.when(F.col("l_returnflag") == "N", "task").when(F.col("l_returnflag") == "A", "decision").otherwise("fact")
    writes = g.table("lineitem").select(F.col("l_orderkey").alias("cycle"), kind.alias("type"), (F.col("l_quantity") / 8).alias("quality"), (F.col("l_linestatus") == "O").alias("created"))
    told = F.floor("value")
    recalls = g.table("events").select(F.col("user_id").alias("session"), told.alias("injected"), F.when(F.col("event_type") == "error", told).otherwise(0).alias("crossed"))
    report = P.session_report(cycles, writes, recalls, "session")
    line = lambda c, name: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[name], x["n"])), " "), F.lit(""))
    return report.withColumn("types", line("types", "type")).withColumn("limits", line("limits", "limit_pass"))


@query(
    "e15_pending_extraction",
    """WITH t AS (SELECT *, turn >= floor((max(turn) OVER (PARTITION BY conv_id) + 1) / 4) * 4 AS waits, split_part(text, ' ', 1) AS name, CASE WHEN length(text) > 600 THEN 'too long: ' || length(text) END AS error FROM conversations),
p AS (SELECT * FROM t WHERE waits)
SELECT conv_id, count(*) AS turns, min(turn) AS first, max(turn) AS last, coalesce((SELECT string_agg(name, '|' ORDER BY k, name) FROM (SELECT name, min(turn) AS k FROM p x WHERE x.conv_id = p.conv_id AND name <> '' GROUP BY name ORDER BY k, name LIMIT 3)), '') AS topics, count(error) > 0 AS failed, arg_max(error, turn) FILTER (error IS NOT NULL) AS last_error FROM p GROUP BY conv_id""",
)
def pending_extraction(g: GraphStore) -> DataFrame:
    """Turns after a conversation's last full four, by their first words; long ones have failed."""
    c = g.table("conversations")
    ends = c.groupBy("conv_id").agg((F.floor((F.max("turn") + 1) / 4) * 4).alias("done"))
    error = F.when(F.length("text") > 600, F.concat(F.lit("too long: "), F.length("text")))
    turns = c.join(ends, "conv_id").select("conv_id", "turn", F.when(F.col("turn") >= F.col("done"), "pass01_done").otherwise("extracted").alias("status"), F.substring_index("text", " ", 1).alias("name"), error.alias("error"))
    return P.pending_extraction(turns, "conv_id").withColumn("topics", F.array_join("topics", "|"))


@query(
    "e15_recent_extractions",
    """WITH r AS (SELECT o_custkey AS agent, o_custkey || ':' || year(o_orderdate) AS range_id, min(o_orderkey) AS first, max(o_orderkey) AS last, max(o_orderdate) AS made FROM orders GROUP BY ALL),
x AS (SELECT DISTINCT o_custkey || ':' || year(o_orderdate) AS range_id, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 20),
n AS (SELECT p_partkey, replace(p_name, ' ', '_') AS label, p_partkey % 40 = 0 AS is_chain, CASE WHEN p_partkey % 3 > 0 THEN p_partkey - p_partkey % CASE WHEN p_partkey % 7 = 0 THEN 30 ELSE 40 END END AS chain_id FROM part),
rows AS (SELECT range_id, n.* FROM x JOIN n ON l_partkey = p_partkey),
topics AS (SELECT range_id, split_part(label, '_', 1) AS topic, count(*) AS c FROM rows GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY c DESC, topic) = 1),
sums AS (SELECT range_id, count(*) AS blocks, min(label) FILTER (is_chain) AS own FROM rows GROUP BY 1),
named AS (SELECT range_id, chain_id, count(*) AS c FROM rows WHERE chain_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY c DESC, chain_id) = 1),
handles AS (SELECT range_id, label AS handle FROM named JOIN n ON n.p_partkey = named.chain_id WHERE is_chain)
SELECT agent, place, range_id, coalesce(topic, 'turns ' || first || '-' || last) AS topic, first || '-' || last AS turns, coalesce(blocks, 0) AS blocks, coalesce(own, handle) AS chain, made AS extracted_at
FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY made DESC, range_id DESC) AS place FROM r) LEFT JOIN topics USING (range_id) LEFT JOIN sums USING (range_id) LEFT JOIN handles USING (range_id) WHERE place <= 3""",
)
def recent_extractions(g: GraphStore) -> DataFrame:
    """The last three years in which each customer ordered, by the parts that they ordered many of; every fortieth part is a chain."""
    o = g.table("orders").withColumn("range_id", F.concat_ws(":", "o_custkey", F.year("o_orderdate")))
    ranges = o.groupBy(F.col("o_custkey").alias("agent"), "range_id").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.max("o_orderdate").alias("at"))
    many = g.table("lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("id"))
    k = F.col("p_partkey")
    chain = F.when(k % 3 > 0, k - k % F.when(k % 7 == 0, 30).otherwise(40))
    nodes = g.table("part").select(k.alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("label"), F.when(k % 40 == 0, "chain").otherwise("artifact").alias("type"), chain.alias("chain_id"))
    return P.recent_extractions(ranges, o.select("o_orderkey", "range_id").join(many, "o_orderkey").select("range_id", "id").distinct(), nodes, "agent", 3).withColumnRenamed("at", "extracted_at")
