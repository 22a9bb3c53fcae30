"""Flags, seams, labels, budgets and goals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flags as L
from ..operators import seams as S
from ..operators.items import REQUIRED
from ..sources.graph import GraphStore, at, now, pick
from .prelude import EDGES, NODES, NOTES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


FLAGS = """
flags AS (SELECT l_orderkey || '-' || l_linenumber AS flag_id, l_linenumber AS line, l_suppkey AS supp, l_partkey AS part, l_quantity::BIGINT AS q,
  (['possible_duplicate', 'resolution_pending', 'island_candidate', 'entity_unresolved', 'provenance'])[(l_partkey % 5 + 1)::INT] AS flag_type, 'p' || l_partkey AS block_a, CASE WHEN l_suppkey % 4 <> 0 THEN 's' || l_suppkey END AS block_b,
  l_returnflag = 'A' AS unknown, l_linenumber % 2 = 0 AS resolver, l_linestatus = 'F' AND l_quantity < 10 AS reviewed, CASE WHEN l_linestatus = 'F' AND l_quantity < 10 THEN 'leave' WHEN l_quantity > 45 THEN 'pending_clarification' END AS verdict FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate) = 1),
said AS (SELECT *, q BETWEEN 15 AND 40 AS judged, (['merge', 'leave', 'split', 'leave'])[(q % 4 + 1)::INT] AS said, supp % 3 = 0 AS high, CASE line % 3 WHEN 0 THEN block_a WHEN 1 THEN block_b ELSE 'x' END AS w FROM flags),
stepped AS (SELECT *, coalesce(w IN (block_a, block_b), false) AS side, CASE WHEN reviewed OR verdict = 'pending_clarification' THEN 'none' WHEN flag_type = 'resolution_pending' THEN 'ask' WHEN flag_type IN ('island_candidate', 'entity_unresolved') THEN 'defer' WHEN resolver AND unknown THEN 'ask' WHEN part % 7 = 0 THEN 'stale' WHEN NOT judged THEN 'wait'
  WHEN said = 'merge' AND high AND (w = block_a OR w = block_b) AND block_b IS NOT NULL THEN 'merge' WHEN said = 'merge' AND NOT (high AND coalesce(w = block_a OR w = block_b, false)) THEN 'ask' ELSE 'record' END AS step FROM said)
"""


def flags(g: GraphStore) -> DataFrame:
    """A flag an order's line, on its part and three suppliers in four; of lines of one number the first by part counts."""
    order = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = g.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*order)).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    q = F.col("l_quantity").cast("bigint")
    done = (F.col("l_linestatus") == "F") & (F.col("l_quantity") < 10)
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("flag_id"),
        pick(("possible_duplicate", "resolution_pending", "island_candidate", "entity_unresolved", "provenance"), F.col("l_partkey")).alias("flag_type"),
        F.concat(F.lit("p"), "l_partkey").alias("block_a"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("s"), "l_suppkey")).alias("block_b"),
        F.when(F.col("l_returnflag") == "A", "unknown").otherwise("same").alias("scope_check"),
        F.when(F.col("l_linenumber") % 2 == 0, "stage_d_resolve").otherwise("audit").alias("origin_writer"),
        F.when(done, F.col("l_shipdate")).alias("reviewed_at"),
        F.when(done, "leave").when(F.col("l_quantity") > 45, L.ASKED).alias("verdict"),
        F.when(done, "none").alias("action"),
        F.lit(None).cast("string").alias("winner"),
        q.alias("q"), "l_linenumber", "l_suppkey", "l_partkey",
    )


PLAIN = ("flag_id", "flag_type", "block_a", "block_b", "scope_check", "origin_writer", "reviewed_at", "verdict", "action", "winner")


def named(f: DataFrame) -> DataFrame:
    return f.withColumn("w", F.when(F.col("l_linenumber") % 3 == 0, F.col("block_a")).when(F.col("l_linenumber") % 3 == 1, F.col("block_b")).otherwise("x"))


@query(
    "g25_flag_lifecycle",
    f"WITH {FLAGS} SELECT flag_id, step, CASE WHEN step = 'ask' THEN 'pending_clarification' WHEN step IN ('defer', 'stale') THEN 'leave' WHEN step IN ('merge', 'record') THEN said ELSE verdict END AS verdict, CASE WHEN step = 'merge' THEN 'archived_loser_and_wired_superseded_by' WHEN step IN ('defer', 'stale', 'record') OR reviewed THEN 'none' END AS action, CASE WHEN step = 'merge' THEN w END AS winner, reviewed OR step IN ('defer', 'stale', 'merge', 'record') AS reviewed FROM stepped",
)
def flag_lifecycle(g: GraphStore) -> DataFrame:
    """Flags after a reviewer's pass over those that are open."""
    f = flags(g)
    judged = named(f).filter("q BETWEEN 15 AND 40").select("flag_id", pick(("merge", "leave", "split", "odd"), F.col("q")).alias("said"), pick(("high", "medium", "low"), F.col("l_suppkey")).alias("confidence"), F.col("w").alias("winner"))
    nodes = g.artifacts().withColumn("status", F.when(F.substring("id", 2, 20).cast("bigint") % 7 == 0, "archived").otherwise(F.col("status")))
    return L.routed(f.select(*PLAIN), nodes, judged, now()).select("flag_id", "step", "verdict", "action", "winner", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query(
    "g25_flag_verdicts",
    f"WITH {FLAGS}, v AS (SELECT *, 1 AS seq, (['merge', 'leave', 'odd', 'split'])[(q % 4 + 1)::INT] AS v, CASE WHEN supp % 9 <> 0 THEN 'seen' END AS reason, line <> 4 AS execute FROM said WHERE part % 3 = 0 UNION ALL SELECT *, 2, 'leave', 'late', false FROM said WHERE part % 3 = 0 AND q > 20), "
    "judged AS (SELECT *, CASE WHEN v = 'odd' THEN 'BAD_VERDICT' WHEN reason IS NULL THEN 'REASON_REQUIRED' WHEN execute AND v = 'merge' AND w IS NULL THEN 'WINNER_REQUIRED' WHEN execute AND v = 'merge' AND NOT coalesce(w = block_a OR w = block_b, false) THEN 'BAD_WINNER' WHEN execute AND v = 'merge' AND block_b IS NULL THEN 'NO_LOSER' WHEN reviewed THEN 'ALREADY_REVIEWED' END AS wrong FROM v) "
    "SELECT flag_id, seq, coalesce(wrong, CASE WHEN row_number() OVER (PARTITION BY flag_id, wrong IS NULL ORDER BY seq) > 1 THEN 'ALREADY_REVIEWED' ELSE 'ok' END) AS outcome FROM judged",
)
def flag_verdicts(g: GraphStore) -> DataFrame:
    """Verdicts of people and agents, and what became of each."""
    f = flags(g)
    n = named(f).filter("l_partkey % 3 = 0")
    first = n.select("flag_id", F.lit(1).alias("seq"), pick(("merge", "leave", "odd", "split"), F.col("q")).alias("said"), F.when(F.col("l_suppkey") % 9 != 0, "seen").alias("reason"), F.col("w").alias("winner"), (F.col("l_linenumber") != 4).alias("execute"))
    late = n.filter("q > 20").select("flag_id", F.lit(2).alias("seq"), F.lit("leave").alias("said"), F.lit("late").alias("reason"), F.col("w").alias("winner"), F.lit(False).alias("execute"))
    return L.applied(f.select(*PLAIN), first.unionByName(late), now())[1]


@query(
    "b20_flags_by_block",
    f"WITH {FLAGS} SELECT block, count(*) AS flags, count(*) FILTER (NOT reviewed AND verdict IS NULL) AS pending, count(*) FILTER (NOT reviewed AND verdict = 'pending_clarification') AS asked, count(*) FILTER (reviewed) AS reviewed FROM (SELECT block_a AS block, reviewed, verdict FROM flags UNION ALL SELECT block_b, reviewed, verdict FROM flags WHERE block_b IS NOT NULL) GROUP BY 1",
)
def flags_by_block(g: GraphStore) -> DataFrame:
    """How many flags name each node on either side, and in which state they are."""
    counts = {"pending": L.pending, "asked": L.asked, "reviewed": lambda f: f.filter("reviewed_at IS NOT NULL")}
    f = flags(g).select(*PLAIN)
    marked = None
    for name, of in counts.items():
        part = of(f).withColumn("state", F.lit(name))
        marked = part if marked is None else marked.unionByName(part)
    return L.by_block(marked).groupBy("block").agg(F.count("*").alias("flags"), *(F.count_if(F.col("state") == name).alias(name) for name in counts))


@query("b20_pending_flags", f"WITH {FLAGS} SELECT flag_id, flag_type FROM flags WHERE NOT reviewed AND verdict IS NULL")
def pending_flags(g: GraphStore) -> DataFrame:
    return L.pending(flags(g)).select("flag_id", "flag_type")


@query("b20_asked_flags", f"WITH {FLAGS} SELECT flag_id, flag_type FROM flags WHERE NOT reviewed AND verdict = 'pending_clarification'")
def asked_flags(g: GraphStore) -> DataFrame:
    return L.asked(flags(g)).select("flag_id", "flag_type")


SHAPED = """shaped AS (SELECT doc_id, id, type, 'n' || doc_id % 7 || '_' || type || '_' || doc_id // 12 AS label, 'n' || doc_id % 7 || '_fact_' || doc_id // 12 AS as_fact,
  doc_id % 9 <> 1 AS observed, doc_id % 4 >= 2 AS implied, doc_id % 5 = 0 AS extra FROM notes)"""


def shaped(g: GraphStore) -> DataFrame:
    """Notes with labels that hold their type, and payloads: some insights lack what sets them apart from facts."""
    k = F.substring("id", 2, 20).cast("bigint")
    n = g.notes().select("id", "type", k.alias("k"), "essence").withColumn("label", F.concat(F.lit("n"), F.col("k") % 7, F.lit("_"), "type", F.lit("_"), F.floor(F.col("k") / 12)))
    empty = F.create_map().cast("map<string,string>")
    observed = F.create_map(F.lit("observation"), F.when(k % 9 == 1, "").otherwise("seen"))
    insight = F.map_concat(observed, F.when(k % 4 >= 2, F.create_map(F.lit("implication"), F.lit("so"))).otherwise(empty), F.when(k % 5 == 0, F.create_map(F.lit("mood"), F.lit("good"))).otherwise(empty))
    return n.withColumn("payload", F.when(F.col("type") == "insight", insight).otherwise(F.create_map(F.lit("value"), F.lit("v"))))


@query("g20_demote_heal", sql("SELECT id, CASE WHEN state = 'healed' THEN 'fact' ELSE type END AS type, CASE WHEN state = 'healed' THEN as_fact ELSE label END AS label, state FROM (SELECT *, CASE WHEN NOT (type = 'insight' AND observed AND NOT implied AND NOT extra) THEN 'skipped' WHEN as_fact IN (SELECT label FROM shaped) THEN 'collided' ELSE 'healed' END AS state FROM shaped)", NOTES, SHAPED))
def demote_heal(g: GraphStore) -> DataFrame:
    return S.healed(shaped(g).select("id", "type", "label", "payload"))


@query("d10_seam_routes", sql("SELECT id, CASE WHEN doc_id % 10 = 3 OR type = 'fact' OR (observed AND implied AND NOT extra) THEN 'proceed' WHEN doc_id % 3 < 1 THEN 'route_back' WHEN observed THEN 'demote' ELSE 'quarantine' END AS route FROM shaped WHERE type IN ('fact', 'insight')", NOTES, SHAPED))
def seam_routes(g: GraphStore) -> DataFrame:
    """Facts and insights by their payload's schema; two in three have been sent back before."""
    return shaped(g).filter("type IN ('fact', 'insight')").select("id", S.alpha(F.col("type"), F.col("payload"), F.col("k") % 3, F.col("k") % 10 == 3).alias("route"))


@query("d10_seam_invariants", sql("SELECT id, CASE WHEN doc_id % 8 = 0 AND type <> 'fact' AND doc_id % 12 = 0 AND essence IS NOT NULL THEN 'type,text' WHEN doc_id % 8 = 0 AND type <> 'fact' THEN 'type' ELSE 'text' END AS changed FROM notes WHERE (doc_id % 8 = 0 AND type <> 'fact') OR (doc_id % 12 = 0 AND essence IS NOT NULL)", NOTES))
def seam_invariants(g: GraphStore) -> DataFrame:
    """What a step changed that it may only read."""
    before = shaped(g).select("id", "k", "type", F.lit("u").alias("unique"), F.col("essence").alias("text"))
    after = before.withColumns({"type": F.when(F.col("k") % 8 == 0, "fact").otherwise(F.col("type")), "text": F.when(F.col("k") % 12 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))})
    return S.beta(before, after).select("id", F.array_join("changed", ",").alias("changed"))


@query(
    "d08_label_rules",
    sql("SELECT id, l AS label, replace(l, '_dead_end_', '_dead-end_') AS repaired, len(string_split(l, '_')) <= 4 OR contains(l, '_dead_end_') AS valid_before, len(string_split(replace(l, '_dead_end_', '_dead-end_'), '_')) <= 4 AS valid_after FROM (SELECT id, project_id || '_' || type || '_order_' || substr(id, 2) || CASE WHEN substr(id, 2)::BIGINT % 5 = 0 THEN '_x' ELSE '' END AS l FROM nodes WHERE id LIKE 'o%')", NODES),
)
def label_rules(g: GraphStore) -> DataFrame:
    """Labels before and after types of two words are hyphenated."""
    k = F.substring("id", 2, 20)
    n = g.work().select("id", F.concat("project_id", F.lit("_"), "type", F.lit("_order_"), k, F.when(k.cast("bigint") % 5 == 0, "_x").otherwise("")).alias("label"))
    fixed = S.repaired_label(F.col("label"), ("dead_end",))
    types = tuple(REQUIRED)
    return n.select("id", "label", fixed.alias("repaired"), S.valid_segments(F.col("label"), types).alias("valid_before"), S.valid_segments(fixed, types).alias("valid_after"))


@query(
    "g33_budget_verdict",
    "SELECT user_id, CASE WHEN f IS NULL AND c IS NULL THEN 'off' WHEN f IS NOT NULL AND k = 'error' THEN 'closed' WHEN k = 'ok' AND user_id % 100 < f THEN 'floor' WHEN spent >= c THEN 'cap' ELSE 'ok' END AS verdict FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 50 END AS f, CASE WHEN user_id % 3 <> 0 THEN 100 END AS c, (['ok', 'error', 'unconfigured'])[((user_id // 2) % 3 + 1)::INT] AS k, coalesce(sum(value) FILTER (ts > TIMESTAMP '2024-01-29'), 0) AS spent FROM events GROUP BY 1)",
)
def budget_verdict(g: GraphStore) -> DataFrame:
    """The floor of the balance first, which no known balance closes, then the cap of the last days' spend."""
    spent = g.table("events").groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("ts") > at("2024-01-29 00:00:00"), F.col("value"))), F.lit(0.0)).alias("spent"))
    u = F.col("user_id")
    return spent.select("user_id", S.budget(F.when(u % 2 == 0, 50), F.when(u % 3 != 0, 100), pick(("ok", "error", "unconfigured"), F.floor(u / 2)), u % 100, F.col("spent")).alias("verdict"))


@query("a16_goal_lines", "SELECT c_custkey, 'vision' AS goal, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'task', CASE WHEN c_custkey % 2 = 0 THEN 'second ' || c_custkey ELSE c_mktsegment END FROM customer")
def goal_lines(g: GraphStore) -> DataFrame:
    """Goals of each customer's text of KEY: value lines."""
    text = F.concat(F.lit("VISION: "), "c_name", F.lit("\nnote: no goal\nTASK:   "), "c_mktsegment", F.lit("  \nMACRO:\n NAV: not at the start"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\nTASK:second "), "c_custkey")).otherwise(""))
    return S.goal_lines(g.table("customer"), "c_custkey", text)


GROUPS = """
blocks AS (SELECT 't' || o_custkey AS group_id, CASE WHEN o_orderkey % 101 <> 0 THEN 'b' || o_orderkey % 400 END AS local_id, CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'novel' ELSE (['task', 'decision', 'fact', 'dead_end'])[(o_orderkey % 4 + 1)::INT] END AS type, o_orderkey AS k FROM orders),
ids AS (SELECT group_id, local_id, count(*) AS copies, bool_or(coalesce(type = 'decision', false)) AS decides FROM blocks WHERE local_id IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT 't' || o_custkey AS group_id, o_orderkey AS s, substr(target_id, 2)::BIGINT AS t FROM evidence JOIN orders ON 'o' || o_orderkey = source_id),
links AS (SELECT group_id, CASE WHEN s % 101 <> 0 THEN 'b' || s % 400 END AS f, CASE WHEN s % 29 = 0 THEN 'gone' WHEN t % 101 <> 0 THEN 'b' || t % 400 END AS t, CASE WHEN s % 7 = 0 THEN 'odd' ELSE 'based_on' END AS type FROM ev),
placed AS (SELECT l.*, a.local_id IS NOT NULL AS has_f, b.local_id IS NOT NULL AS has_t FROM links l LEFT JOIN ids a ON a.group_id = l.group_id AND a.local_id = l.f LEFT JOIN ids b ON b.group_id = l.group_id AND b.local_id = l.t),
issues AS (SELECT group_id, local_id, severity, issue, sum(n)::BIGINT AS n FROM (
  SELECT group_id, local_id, 'error' AS severity, 'no_id' AS issue, 1 AS n FROM blocks WHERE local_id IS NULL
  UNION ALL SELECT group_id, local_id, 'error', 'no_type', 1 FROM blocks WHERE local_id IS NOT NULL AND type IS NULL
  UNION ALL SELECT group_id, local_id, 'error', 'no_provenance', 1 FROM blocks WHERE local_id IS NOT NULL AND k % 97 = 0
  UNION ALL SELECT group_id, local_id, 'warning', 'unknown_type', 1 FROM blocks WHERE local_id IS NOT NULL AND type = 'novel' AND k % 2 = 1
  UNION ALL SELECT group_id, local_id, 'warning', 'no_essence', 1 FROM blocks WHERE local_id IS NOT NULL AND k % 13 = 0
  UNION ALL SELECT group_id, local_id, 'warning', 'payload', 1 FROM blocks WHERE local_id IS NOT NULL AND (type IN ('task', 'dead_end') OR (type = 'decision' AND k % 3 = 0))
  UNION ALL SELECT group_id, local_id, 'error', 'duplicate_id', copies - 1 FROM ids WHERE copies > 1
  UNION ALL SELECT group_id, f, 'warning', 'unknown_link', 1 FROM placed WHERE type = 'odd'
  UNION ALL SELECT group_id, f, 'warning', 'no_such_from', 1 FROM placed WHERE NOT has_f
  UNION ALL SELECT group_id, t, 'warning', 'no_such_to', 1 FROM placed WHERE NOT has_t
  UNION ALL SELECT group_id, local_id, 'warning', 'no_evidence', 1 FROM ids i WHERE decides AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.group_id = i.group_id AND p.f = i.local_id AND p.type = 'based_on' AND p.has_t)) GROUP BY 1, 2, 3, 4)
"""


def extraction(g: GraphStore) -> tuple[DataFrame, DataFrame]:
    """Blocks and links of groups: a customer's orders, with defects, and what they rest on."""
    k = F.col("o_orderkey")
    local = lambda x: F.when(x % 101 != 0, F.concat(F.lit("b"), x % 400))
    kind = F.when(k % 89 == 0, F.lit(None)).when(k % 19 == 0, "novel").otherwise(pick(("task", "decision", "fact", "dead_end"), k))
    one = lambda *kv: F.create_map(*map(F.lit, kv))
    payload = F.when(kind == "task", one("status", "open")).when(kind == "decision", F.when(k % 3 == 0, one("choice", "")).otherwise(one("choice", "a"))).when(kind == "dead_end", one("approach", "a", "reason", "b", "mood", "c")).otherwise(one("value", "v"))
    o = g.table("orders")
    blocks = o.select(F.concat(F.lit("t"), "o_custkey").alias("group_id"), local(k).alias("local_id"), kind.alias("type"), (k % 2 == 0).alias("own_schema"), F.when(k % 97 != 0, "said").alias("provenance"), F.when(k % 13 == 0, " ").otherwise("essence").alias("essence"), payload.alias("payload"))
    s, t = F.substring("source_id", 2, 20).cast("bigint"), F.substring("target_id", 2, 20).cast("bigint")
    e = g.evidence().select(s.alias("o_orderkey"), t.alias("t")).join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
    links = e.select(F.concat(F.lit("t"), "o_custkey").alias("group_id"), local(k).alias("from"), F.when(k % 29 == 0, "gone").otherwise(local(F.col("t"))).alias("to"), F.when(k % 7 == 0, "odd").otherwise("based_on").alias("type"))
    return blocks, links


@query("d09_validation", sql("SELECT * FROM issues", EDGES, GROUPS))
def validation(g: GraphStore) -> DataFrame:
    return S.issues(*extraction(g))


@query(
    "d22_group_stitch",
    sql(
        "SELECT g.group_id, b.group_id || '::' || b.local_id AS qualified, coalesce(g.project, m.modal, g.topic) AS project, x.group_id IS NOT NULL AS quarantined FROM groups g LEFT JOIN bad x ON x.group_id = g.group_id LEFT JOIN modal m ON m.result = g.result LEFT JOIN (SELECT * FROM blocks WHERE group_id NOT IN (SELECT group_id FROM bad)) b ON b.group_id = g.group_id",
        EDGES,
        GROUPS,
        """groups AS (SELECT c_nationkey AS result, 't' || c_custkey AS group_id, c_mktsegment AS topic, CASE WHEN c_custkey % 3 <> 0 THEN 'p' || c_custkey % 5 END AS project FROM customer),
bad AS (SELECT DISTINCT group_id FROM issues WHERE severity = 'error'),
modal AS (SELECT result, arg_min(project, (-n, project)) AS modal FROM (SELECT result, project, count(*) AS n FROM groups WHERE project IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""",
    ),
)
def group_stitch(g: GraphStore) -> DataFrame:
    """Every customer is a group of its nation's extraction; those with an error are emptied."""
    k = F.col("c_custkey")
    groups = g.table("customer").select(F.col("c_nationkey").alias("result"), F.concat(F.lit("t"), k).alias("group_id"), F.col("c_mktsegment").alias("topic"), F.when(k % 3 != 0, F.concat(F.lit("p"), k % 5)).alias("project"))
    blocks, links = extraction(g)
    return S.stitched(groups, blocks, S.issues(blocks, links))
