"""Upkeep of the driver's graph: sweep, conflicts, merges and links between groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports as P
from ..operators import temporal as H
from ..operators import upkeep as U
from ..sources.graph import GraphStore, at, current, live, now, pick
from .prelude import EDGES, NODES, NOTES, sql
from .reports import key_of

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


#: Labels that a sweep leaves out.
KEPT = ("order_4", "order_8", "order_12")


def sweep(g: GraphStore) -> DataFrame:
    """Open orders; a third of their evidence supersedes what it is based on, and large lines are flags."""
    evidence = g.evidence().withColumn("type", F.when(key_of("source_id") % 3 == 0, "supersedes").otherwise("based_on"))
    flags = g.table("lineitem").filter("l_quantity > 45").select(
        pick(("possible_duplicate", "resolution_pending", "provenance"), F.col("l_partkey")).alias("flag_type"), F.concat(F.lit("o"), "l_orderkey").alias("block_a"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("s"), "l_suppkey")).alias("block_b"), F.when(F.col("l_linestatus") == "F", now()).alias("reviewed_at"),
    )
    return U.swept(live(g.work()), current(g.prompts().unionByName(evidence)), flags, list(KEPT))


_SWEEP = """
rel AS (SELECT source_id, target_id, type FROM prompts UNION ALL SELECT source_id, target_id, CASE WHEN substr(source_id, 2)::BIGINT % 3 = 0 THEN 'supersedes' ELSE 'based_on' END FROM evidence),
item AS (SELECT * FROM live WHERE type = 'task' AND work_status <> 'done'),
cand AS (
  SELECT i.id, n.id AS candidate, 1 AS rank, n.created_at AS made, n.project_id FROM item i JOIN rel ON target_id = i.id AND rel.type = 'supersedes' JOIN live n ON n.id = source_id WHERE n.id LIKE 'o%'
  UNION ALL SELECT i.id, n.id, 2, n.created_at, n.project_id FROM item i JOIN (SELECT source_id AS x, target_id AS y FROM rel UNION SELECT target_id, source_id FROM rel) ON x = i.id JOIN live n ON n.id = y WHERE n.id LIKE 'o%' AND n.type IN ('event', 'decision', 'fact') AND n.created_at > i.created_at),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, made DESC, candidate) = 1),
flagged AS (SELECT DISTINCT 'o' || l_orderkey AS id FROM lineitem WHERE l_quantity > 45 AND l_partkey % 3 = 1 AND l_linestatus <> 'F'),
swept AS (SELECT i.id, CASE WHEN i.label NOT IN ('order_4', 'order_8', 'order_12') THEN candidate END AS candidate, CASE WHEN i.label NOT IN ('order_4', 'order_8', 'order_12') THEN CASE rank WHEN 1 THEN 'superseded' WHEN 2 THEN 'neighbour' END END AS signal,
  CASE WHEN i.label NOT IN ('order_4', 'order_8', 'order_12') AND candidate IS NOT NULL THEN CASE WHEN b.project_id = i.project_id THEN 'same' ELSE 'unknown' END END AS scope_check,
  CASE WHEN i.label IN ('order_4', 'order_8', 'order_12') THEN 'excluded' WHEN candidate IS NULL THEN 'none' WHEN i.id IN (SELECT id FROM flagged) THEN 'existing' ELSE 'flagged' END AS outcome FROM item i LEFT JOIN best b USING (id))"""


@query("g17_sweep", sql("SELECT * FROM swept", NODES, EDGES, ctes=_SWEEP))
def swept(g: GraphStore) -> DataFrame:
    """Open tasks with what may have settled them."""
    return sweep(g)


@query("g17_sweep_flags", sql("SELECT md5('resolution_pending|' || id || '|' || candidate) AS flag_id, id AS block_a, candidate AS block_b, scope_check, 'pending_clarification' AS verdict FROM swept WHERE outcome = 'flagged'", NODES, EDGES, ctes=_SWEEP))
def sweep_flags(g: GraphStore) -> DataFrame:
    """The flags that the sweep writes."""
    return U.sweep_flags(sweep(g)).select("flag_id", "block_a", "block_b", "scope_check", "verdict")


def conflicts(g: GraphStore) -> DataFrame:
    """A conflict for every order and what it is based on, found in both orders at times; some were open before, some closed."""
    e = g.evidence().select(F.col("source_id").alias("block_a"), F.col("target_id").alias("block_b"), ((key_of("source_id") % 100) / 100).alias("similarity"), F.col("created_at").alias("detected_at"))
    k = key_of("block_a")
    swapped = e.filter(k % 4 == 0).select(F.col("block_b").alias("block_a"), F.col("block_a").alias("block_b"), "similarity", (F.col("detected_at") - F.make_dt_interval(days=F.lit(1))).alias("detected_at"))
    before = e.filter(k % 5 == 0).select(F.concat_ws("-", F.lit("old"), "block_a", "block_b").alias("conflict_id"), "block_a", "block_b", F.lit(0.5).alias("similarity"), "detected_at", F.when(k % 10 == 0, "keep_a").alias("resolution"))
    return U.conflicts_after(before, e.unionByName(swapped))


_CONFLICTS = """
e AS (SELECT source_id AS block_a, target_id AS block_b, (substr(source_id, 2)::BIGINT % 100) / 100 AS similarity, created_at AS detected_at, substr(source_id, 2)::BIGINT AS k FROM evidence),
old AS (SELECT 'old-' || block_a || '-' || block_b AS conflict_id, block_a, block_b, 0.5::DOUBLE AS similarity, detected_at, CASE WHEN k % 10 = 0 THEN 'keep_a' END AS resolution FROM e WHERE k % 5 = 0),
found AS (SELECT block_a, block_b, similarity, detected_at FROM e UNION ALL SELECT block_b, block_a, similarity, detected_at - INTERVAL 1 DAY FROM e WHERE k % 4 = 0),
fresh AS (SELECT *, least(block_a, block_b) AS low, greatest(block_a, block_b) AS high FROM found QUALIFY row_number() OVER (PARTITION BY least(block_a, block_b), greatest(block_a, block_b) ORDER BY detected_at, similarity DESC, block_a) = 1),
conflicts AS (SELECT * FROM old UNION ALL SELECT 'cnf_' || md5(low || '|' || high || '|' || strftime(detected_at, '%Y%m%d%H%M%S') || '000000'), block_a, block_b, similarity, detected_at, NULL FROM fresh WHERE NOT EXISTS (SELECT 1 FROM old WHERE resolution IS NULL AND least(old.block_a, old.block_b) = low AND greatest(old.block_a, old.block_b) = high)),
said AS (SELECT conflict_id, 1 AS seq, (['keep_a', 'keep_b', 'merge', 'merge', 'drop'])[(j % 5 + 1)::INT] AS said, CASE WHEN j % 5 = 2 THEN 'one of ' || block_a END AS essence FROM (SELECT *, substr(block_a, 2)::BIGINT AS j FROM conflicts) WHERE j % 6 <> 5
  UNION ALL SELECT conflict_id, 2, 'keep_b', NULL FROM conflicts WHERE substr(block_b, 2)::BIGINT % 3 = 0),
judged AS (SELECT s.*, block_a, block_b, c.resolution IS NULL AS was_open, s.said IN ('keep_a', 'keep_b') OR essence IS NOT NULL AS ok FROM said s JOIN conflicts c USING (conflict_id)),
outcomes AS (SELECT *, CASE WHEN NOT was_open OR seq > coalesce(min(seq) FILTER (ok AND was_open) OVER (PARTITION BY conflict_id), 9) THEN 'NOT_FOUND' WHEN NOT ok THEN 'BAD_RESOLUTION' ELSE 'ok' END AS outcome FROM judged)"""


@query("g24_conflicts", sql("SELECT * FROM conflicts", EDGES, ctes=_CONFLICTS))
def found_conflicts(g: GraphStore) -> DataFrame:
    """Conflicts after the pairs found now."""
    return conflicts(g)


def resolved(g: GraphStore) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = conflicts(g)
    j = key_of("block_a")
    first = c.filter(j % 6 != 5).select("conflict_id", F.lit(1).alias("seq"), pick(("keep_a", "keep_b", "merge", "merge", "drop"), j).alias("said"), F.when(j % 5 == 2, F.concat(F.lit("one of "), "block_a")).alias("merged_essence"), F.lit("seen").alias("reason"))
    second = c.filter(key_of("block_b") % 3 == 0).select("conflict_id", F.lit(2).alias("seq"), F.lit("keep_b").alias("said"), F.lit(None).cast("string").alias("merged_essence"), F.lit("").alias("reason"))
    return U.resolved(c, g.work(), first.unionByName(second), now())


@query("g24_resolved", sql("SELECT c.conflict_id, c.block_a, c.block_b, coalesce(c.resolution, said || CASE WHEN seq = 1 THEN ': seen' ELSE '' END) AS resolution FROM conflicts c LEFT JOIN outcomes o ON o.conflict_id = c.conflict_id AND outcome = 'ok'", EDGES, ctes=_CONFLICTS))
def resolved_conflicts(g: GraphStore) -> DataFrame:
    """Conflicts after decisions on them."""
    return resolved(g)[0].select("conflict_id", "block_a", "block_b", "resolution")


@query(
    "g24_resolved_nodes",
    sql(
        "SELECT n.id, CASE WHEN gone THEN 'archived' ELSE n.status END AS status, coalesce(text, essence) AS essence, CASE WHEN x.id IS NULL THEN n.updated_at ELSE TIMESTAMP '2024-02-01' END AS updated_at FROM nodes n LEFT JOIN x USING (id) WHERE n.id LIKE 'o%'",
        NODES,
        EDGES,
        ctes=_CONFLICTS
        + """,
x AS (SELECT id, bool_or(gone) AS gone, arg_max(text, (seq, conflict_id)) FILTER (text IS NOT NULL) AS text FROM (SELECT CASE WHEN said = 'keep_b' THEN block_a ELSE block_b END AS id, true AS gone, NULL AS text, seq, conflict_id FROM outcomes WHERE outcome = 'ok' UNION ALL SELECT block_a, false, essence, seq, conflict_id FROM outcomes WHERE outcome = 'ok' AND said = 'merge') GROUP BY 1)""",
    ),
)
def resolved_nodes(g: GraphStore) -> DataFrame:
    """Orders after the decisions on their conflicts."""
    return resolved(g)[1].select("id", "status", "essence", "updated_at")


@query("g24_outcomes", sql("SELECT conflict_id, seq, outcome FROM outcomes", EDGES, ctes=_CONFLICTS))
def outcomes(g: GraphStore) -> DataFrame:
    """What became of each decision."""
    return resolved(g)[2]


def merged(g: GraphStore) -> tuple[DataFrame, DataFrame]:
    """Documents as items, each with references to the documents of half and a third of its number."""
    k = key_of()
    items = g.notes().select("id", "type", F.col("essence").alias("value"), k.alias("place"), F.col("project_id").alias("group"))
    d = g.table("documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("source_id"))
    k = F.col("doc_id")
    ref = lambda n, kind: d.select("source_id", F.concat(F.lit("d"), F.floor(k / n)).alias("target_id"), kind.alias("kind"))
    return U.merged_items(items, ref(2, pick(("based_on", "prompted_by", "extends", "supersedes"), k)).unionByName(ref(3, F.lit("based_on"))))


_MERGED = """
item AS (SELECT d.doc_id, d.source, n.type, CASE WHEN norm = '' THEN '=' || d.doc_id ELSE norm END AS norm FROM documents d JOIN notes n USING (doc_id) JOIN normal k USING (doc_id)),
moved AS (SELECT doc_id, 'd' || doc_id AS id, 'd' || min(doc_id) OVER w AS into_id, count(*) OVER w AS copies, type, norm, source FROM item WINDOW w AS (PARTITION BY type, norm)),
ref AS (SELECT doc_id, 'd' || doc_id // 2 AS t, (['based_on', 'prompted_by', 'extends', 'supersedes'])[(doc_id % 4 + 1)::INT] AS kind FROM documents UNION ALL SELECT doc_id, 'd' || doc_id // 3, 'based_on' FROM documents),
fixed AS (SELECT s.into_id AS f, coalesce(o.into_id, t) AS t, kind, ref.doc_id FROM ref JOIN moved s USING (doc_id) LEFT JOIN moved o ON o.id = t)"""


@query("d06_merged_items", sql("SELECT id, into_id AS into, copies, groups FROM moved JOIN (SELECT type, norm, string_agg(source, ',' ORDER BY source) AS groups FROM (SELECT DISTINCT type, norm, source FROM moved) GROUP BY 1, 2) USING (type, norm)", NOTES, ctes=_MERGED))
def merged_items(g: GraphStore) -> DataFrame:
    """Documents with the first of their type and text."""
    return merged(g)[0].withColumn("groups", F.array_join("groups", ","))


@query("d06_moved_references", sql("SELECT DISTINCT f AS source_id, t AS target_id, kind FROM fixed WHERE f <> t AND kind IN ('based_on', 'prompted_by') UNION ALL SELECT f, arg_min(t, doc_id), kind FROM fixed WHERE f <> t AND kind IN ('extends', 'supersedes') GROUP BY f, kind", NOTES, ctes=_MERGED))
def moved_references(g: GraphStore) -> DataFrame:
    """The references after the merge."""
    return merged(g)[1]


@query(
    "d21_guarded_links",
    """WITH p AS (SELECT l_partkey AS a, l_suppkey * 7 AS b, (['based_on', 'causes', 'supports', 'extends'])[(l_linenumber % 4 + 1)::INT] AS type FROM lineitem)
SELECT 'd' || a AS source_id, 'd' || b AS target_id, type, CASE WHEN x.doc_id IS NULL OR y.doc_id IS NULL THEN 'unknown_id' WHEN a = b THEN 'self_link' WHEN x.source IS NOT DISTINCT FROM y.source THEN 'same_group' WHEN type = 'causes' THEN 'unknown_type' ELSE 'added' END AS outcome, count(*) AS n
FROM p LEFT JOIN documents x ON x.doc_id = a LEFT JOIN documents y ON y.doc_id = b GROUP BY ALL""",
)
def guarded_links(g: GraphStore) -> DataFrame:
    """Links between documents of different sources, proposed by every line, with their outcome."""
    items = g.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("group"))
    li = g.table("lineitem").select(F.concat(F.lit("d"), "l_partkey").alias("source_id"), F.concat(F.lit("d"), F.col("l_suppkey") * 7).alias("target_id"), pick(("based_on", "causes", "supports", "extends"), F.col("l_linenumber")).alias("type"))
    return U.guarded(items, li).groupBy("source_id", "target_id", "type", "outcome").agg(F.count("*").alias("n"))


@query(
    "g26_claim_attempts",
    """WITH RECURSIVE e AS (SELECT event_id AS seq, user_id % 10 AS block, event_id % 3 AS agent, ts AS tm, event_type = 'signup' AS frees FROM events),
att AS MATERIALIZED (SELECT a.seq, a.block, a.agent, a.tm, least(a.tm + INTERVAL 6 HOUR + INTERVAL 1 MICROSECOND, coalesce(min(r.tm), TIMESTAMP '2100-01-01')) AS ends FROM e a LEFT JOIN e r ON r.frees AND r.block = a.block AND r.agent = a.agent AND r.tm > a.tm WHERE NOT a.frees GROUP BY a.seq, a.block, a.agent, a.tm),
jump AS MATERIALIZED (SELECT a.seq, arg_min(b.seq, (b.tm, b.seq)) AS nxt FROM att a JOIN att b ON b.block = a.block AND b.tm >= a.ends GROUP BY 1),
won AS (SELECT arg_min(seq, (tm, seq)) AS seq FROM att GROUP BY block UNION ALL SELECT nxt FROM won JOIN jump USING (seq)),
held AS (SELECT att.* FROM att JOIN won USING (seq))
SELECT a.seq, a.block, a.agent, a.tm AS at, a.seq IN (SELECT seq FROM won) AS claimed, h.agent AS claimed_by, CASE WHEN a.seq IN (SELECT seq FROM won) THEN a.tm + INTERVAL 6 HOUR END AS expires_at FROM att a ASOF JOIN held h ON h.block = a.block AND a.tm >= h.tm""",
)
def claim_attempts(g: GraphStore) -> DataFrame:
    """Ten blocks that three agents claim for six hours with every event, or give back with a signup."""
    e = g.table("events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("block"), (F.col("event_id") % 3).alias("agent"), F.col("ts").alias("at"), "event_type")
    return H.claims(e.filter("event_type <> 'signup'"), e.filter("event_type = 'signup'"), 6 * 3600)


@query(
    "g34_reminders",
    """WITH e AS (SELECT event_id AS id, user_id AS client, CASE WHEN event_type <> 'signup' THEN event_id % 7 END AS file, ts AS tm FROM events WHERE event_type <> 'view'),
r AS (SELECT e.*, v.ts AS read, date_diff('microsecond', v.ts, e.tm) AS ago FROM e ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view') v ON v.user_id = e.client AND e.tm >= v.ts),
w AS (SELECT *, CASE WHEN read IS NULL THEN 'never' WHEN ago > 172800000000 THEN 'stale' WHEN file IS NULL THEN 'no_file' WHEN ago < 7200000000 THEN 'grace' END AS y FROM r),
f AS (SELECT *, coalesce(y, CASE WHEN row_number() OVER (PARTITION BY client, file, read, y IS NULL ORDER BY tm, id) = 1 THEN 'new_file' ELSE 'seen' END) AS why FROM w)
SELECT id, client, file::VARCHAR AS file, tm AS at, why, why IN ('never', 'stale', 'new_file') AS remind FROM f""",
)
def reminders(g: GraphStore) -> DataFrame:
    """Whether each event of a user who edits one of seven files calls for a reminder, views being reads."""
    e = g.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), F.when(F.col("event_type") != "signup", F.col("event_id") % 7).cast("string").alias("file"), F.col("ts").alias("at"), "event_type")
    return H.reminders(e.filter("event_type <> 'view'"), e.filter("event_type = 'view'"), 2 * 86400, 2 * 3600)


@query(
    "b17_overview",
    sql(
        """SELECT 'nodes' AS section, type AS name, count(*) AS n, NULL::TIMESTAMP AS at FROM live GROUP BY 2
UNION ALL SELECT 'projects', id, NULL, NULL FROM live WHERE type = 'project'
UNION ALL SELECT 'open_tasks', id, NULL, NULL FROM live WHERE type = 'task' AND work_status <> 'done'
UNION ALL (SELECT 'recent', id, NULL, created_at FROM live ORDER BY created_at DESC, id LIMIT 5)
UNION ALL SELECT 'active_agents', user_id::VARCHAR, count(*), max(ts) FROM events GROUP BY 2 HAVING max(ts) >= TIMESTAMP '2024-01-30 22:00:00'
UNION ALL SELECT 'unlinked', NULL, count(*), NULL FROM live WHERE project_id IS NULL AND type <> 'project' AND id NOT IN (SELECT source_id FROM cur UNION ALL SELECT target_id FROM cur)""",
        NODES,
        EDGES,
    ),
)
def overview(g: GraphStore) -> DataFrame:
    """What a session sees first: nodes by type, projects, open tasks, the five newest, agents of the last two hours, and how many nodes hang nowhere."""
    activity = g.table("events").select(F.col("user_id").cast("string").alias("agent"), F.col("ts").alias("at"))
    return P.overview(live(g.nodes()), current(g.edges()), activity, at("2024-01-30 22:00:00"))
