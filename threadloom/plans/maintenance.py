"""Lifecycle, audit, item and time queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit as A
from ..operators import items as I
from ..operators import temporal as H
from ..sources.graph import GraphStore, at, current, live, normal_text, now
from .prelude import EDGES, NODES, NOTES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


def spine(g: GraphStore) -> DataFrame:
    return g.prompts().unionByName(g.evidence())


# lifecycle


@query("g01_promote_hot", sql("SELECT type, count(*) AS promoted FROM live WHERE ttl IN ('session', '1hr') AND access_count >= 3 GROUP BY 1", NODES))
def promote_hot(g: GraphStore) -> DataFrame:
    return A.promoted(live(g.nodes())).filter("promoted").groupBy("type").agg(F.count("*").alias("promoted"))


@query(
    "g02_gc",
    sql(
        "SELECT type, action, count(*) AS n FROM (SELECT n.id, n.type, CASE WHEN n.type IN ('decision', 'constraint', 'project') OR t = 'permanent' OR held THEN 'protect' WHEN date_diff('second', updated_at, TIMESTAMP '2024-02-01') > CASE t WHEN '1hr' THEN 1 WHEN '24hr' THEN 24 WHEN '1week' THEN 168 WHEN 'session' THEN 24 END * 3600 THEN 'archive' ELSE 'keep' END AS action FROM (SELECT *, CASE WHEN ttl IN ('session', '1hr') AND access_count >= 3 THEN 'permanent' ELSE ttl END AS t FROM live) n LEFT JOIN (SELECT DISTINCT target_id AS id, true AS held FROM evidence UNION SELECT DISTINCT source_id, true FROM evidence) h ON h.id = n.id) GROUP BY 1, 2",
        NODES,
        EDGES,
    ),
)
def gc(g: GraphStore) -> DataFrame:
    return A.collected(g.nodes(), g.evidence(), now()).groupBy("type", "action").agg(F.count("*").alias("n"))


@query("g03_archive_closes", sql("SELECT e.type, count(*) AS closed FROM cur e JOIN nodes n ON n.id = e.source_id WHERE n.status = 'archived' GROUP BY 1", NODES, EDGES))
def archive_closes(g: GraphStore) -> DataFrame:
    """Outgoing edges that end with the archiving of their source."""
    gone = g.nodes().filter("status = 'archived'").select(F.col("id").alias("source_id"))
    return current(g.edges()).join(gone, "source_id", "left_semi").groupBy("type").agg(F.count("*").alias("closed"))


@query(
    "g04_gaps",
    sql(
        "SELECT 'orphan' AS gap, id FROM live WHERE id NOT IN (SELECT source_id FROM cur UNION SELECT target_id FROM cur) UNION ALL SELECT 'task_without_cause', id FROM live WHERE type = 'task' AND id NOT IN (SELECT source_id FROM spine) UNION ALL SELECT 'dead_end_without_conflict', id FROM live WHERE type = 'dead_end' AND id NOT IN (SELECT source_id FROM cur WHERE type = 'contradicts')",
        NODES,
        EDGES,
    ),
)
def gaps(g: GraphStore) -> DataFrame:
    return A.gaps(g.nodes(), g.edges())


@query("g06_shared_tokens", "WITH w AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.item_id < b.item_id WHERE length(a.word) >= 4 GROUP BY 1, 2 HAVING count(*) >= 3")
def shared_tokens(g: GraphStore) -> DataFrame:
    return A.shared_tokens(g.table("benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("scope"), F.col("text").alias("value")), 3)


@query("g07_scope_disagreement", sql("SELECT md5(norm) AS digest, min(n.doc_id) AS first, count(*) AS n, count(DISTINCT source) AS scopes FROM normal n JOIN documents d USING (doc_id) WHERE norm <> '' GROUP BY 1 HAVING count(*) > 1", NOTES))
def scope_disagreement(g: GraphStore) -> DataFrame:
    d = g.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), "text")
    return A.equal_values(d, normal_text(F.col("text")))


@query("g08_block_duplicates", sql("SELECT r.source_id AS id, r.target_id AS twin, CASE WHEN a.project_id = b.project_id THEN 'same_scope' ELSE 'other_scope' END AS scope, a.type = b.type AS same_type FROM revisions r JOIN notes a ON a.id = r.source_id JOIN notes b ON b.id = r.target_id", NOTES))
def block_duplicates(g: GraphStore) -> DataFrame:
    """Equal values, each with the one before it."""
    n = g.notes().select("id", "project_id", "type")
    a, b = n.alias("a"), n.alias("b")
    r = g.revisions().select("source_id", "target_id")
    pairs = r.join(a, F.expr("a.id = source_id")).join(b, F.expr("b.id = target_id"))
    return pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("twin"), F.when(F.expr("a.project_id = b.project_id"), "same_scope").otherwise("other_scope").alias("scope"), F.expr("a.type = b.type").alias("same_type"))


@query(
    "g09_islands",
    sql(
        "SELECT a.first AS a, b.first AS b, a.nodes AS a_nodes, b.nodes AS b_nodes, len(list_intersect(a.cs, b.cs))::BIGINT AS shared FROM kinds a JOIN kinds b ON a.first < b.first AND len(list_intersect(a.cs, b.cs)) >= 3",
        NODES,
        ctes="kinds AS (SELECT list_sort(list_distinct(concepts)) AS cs, count(*) AS nodes, min(id) AS first FROM live WHERE type = 'artifact' GROUP BY 1)",
    ),
)
def islands(g: GraphStore) -> DataFrame:
    return A.islands(live(g.artifacts()).select("id", "concepts"), 3, g.evidence())


@query(
    "g13_merge",
    sql(
        "SELECT type, count(*) AS n, count(DISTINCT source_id) AS sources FROM (SELECT DISTINCT coalesce(a.winner, e.source_id) AS source_id, coalesce(b.winner, e.target_id) AS target_id, e.type FROM cur e LEFT JOIN w a ON a.loser = e.source_id LEFT JOIN w b ON b.loser = e.target_id WHERE e.type IN ('prompted_by', 'based_on', 'depends_on', 'affects', 'contradicts') AND coalesce(a.winner, e.source_id) <> coalesce(b.winner, e.target_id) UNION ALL SELECT winner, loser, 'supersedes' FROM w) GROUP BY 1",
        NODES,
        EDGES,
        ctes="w AS (SELECT id AS loser, 'o' || (substr(id, 2)::BIGINT + 1) AS winner FROM nodes WHERE status = 'archived')",
    ),
)
def merge(g: GraphStore) -> DataFrame:
    """Archived orders give their edges to the order after them by number."""
    w = g.work().filter("status = 'archived'").select(F.col("id").alias("loser"), F.concat(F.lit("o"), F.substring("id", 2, 20).cast("bigint") + 1).alias("winner"))
    return A.merged(current(spine(g).unionByName(g.supplies())), w).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


@query("g15_work_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS status, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS note FROM orders")
def work_status(g: GraphStore) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", " Shipped ").when(F.col("o_orderstatus") == "P", "WIP").otherwise(F.col("o_orderpriority"))
    return g.table("orders").select("o_orderkey", A.work_status(raw).alias("s")).select("o_orderkey", "s.status", "s.note")


@query("g16_resolves_heal", sql("SELECT target_id AS id, count(*) AS resolvers FROM cur e JOIN nodes n ON n.id = e.target_id JOIN nodes s ON s.id = e.source_id WHERE e.type = 'prompted_by' AND n.type = 'task' AND n.work_status = 'open' AND s.work_status = 'done' GROUP BY 1", NODES, EDGES))
def resolves_heal(g: GraphStore) -> DataFrame:
    """Open tasks that a finished follower closes."""
    work = g.work()
    open_ = work.filter("type = 'task' AND work_status = 'open'").select(F.col("id").alias("target_id"))
    done = work.filter("work_status = 'done'").select(F.col("id").alias("source_id"))
    return current(g.prompts()).join(open_, "target_id", "left_semi").join(done, "source_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("resolvers"))


@query(
    "g17_zombies",
    sql("SELECT id, arg_max(other, (t, other)) AS closer FROM (SELECT e.target_id AS id, e.source_id AS other, s.created_at AS t FROM cur e JOIN live n ON n.id = e.target_id JOIN live s ON s.id = e.source_id WHERE e.type IN ('prompted_by', 'based_on') AND n.type = 'task' AND n.work_status = 'open' AND s.type IN ('fact', 'decision') AND s.created_at > n.created_at) GROUP BY 1", NODES, EDGES),
)
def zombies(g: GraphStore) -> DataFrame:
    """Open tasks with the newest later fact or decision beside them."""
    work = live(g.work())
    open_ = work.filter("type = 'task' AND work_status = 'open'").select(F.col("id").alias("target_id"), F.col("created_at").alias("opened"))
    later = work.filter("type IN ('fact', 'decision')").select(F.col("id").alias("source_id"), F.col("created_at").alias("t"))
    pairs = current(spine(g)).select("source_id", "target_id").join(open_, "target_id").join(later, "source_id").filter("t > opened")
    return pairs.groupBy(F.col("target_id").alias("id")).agg(F.max(F.struct("t", "source_id"))["source_id"].alias("closer"))


@query(
    "g18_provenance",
    sql(
        "SELECT d.doc_id, b.item_id, CASE WHEN contains(n.norm, b.norm) THEN 'exact' WHEN len(list_intersect(b.w, list_distinct(string_split_regex(lower(d.text), '[^a-z0-9]+')))) / greatest(len(b.w), 1) >= 0.85 THEN 'fuzzy' ELSE 'missing' END AS state FROM documents d JOIN normal n USING (doc_id) JOIN claims b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)",
        NOTES,
        ctes="claims AS (SELECT item_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n]+', ' ', 'g')) AS norm, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda x: x <> '') AS w FROM benchmark)",
    ),
)
def provenance(g: GraphStore) -> DataFrame:
    """Whether each document holds the passage it is linked to; links go round all passages."""
    claims = g.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("excerpt"))
    number = g.table("benchmark").agg(F.count("*").alias("passages"))
    docs = g.table("documents").crossJoin(F.broadcast(number)).select("doc_id", (F.col("doc_id") % F.col("passages")).alias("id"), "text")
    found = A.provenance(claims, docs)
    return found.filter("state <> 'no_link'").select("doc_id", F.col("id").alias("item_id"), "state")


@query(
    "g18_held_passages",
    """
WITH claims AS (SELECT item_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n]+', ' ', 'g')) AS norm, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda x: x <> '') AS w FROM benchmark),
docs AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n]+', ' ', 'g')) AS norm, list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM documents),
found AS (SELECT * FROM (SELECT doc_id, item_id, CASE WHEN contains(d.norm, b.norm) THEN 'exact' WHEN len(list_intersect(b.w, d.w)) / greatest(len(b.w), 1) >= 0.85 THEN 'fuzzy' END AS state FROM docs d, claims b WHERE b.norm <> '') WHERE state IS NOT NULL)
SELECT doc_id, item_id, state FROM found UNION ALL SELECT doc_id, NULL, 'missing' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id)""",
)
def held_passages(g: GraphStore) -> DataFrame:
    """Every passage that each document holds; g18_provenance looks at one linked passage a document only."""
    return A.held_passages(g.table("benchmark").select("item_id", "text"), g.table("documents").select("doc_id", "text"))


@query("g21_describe_selection", sql("SELECT project_id, count(*) AS members, count(*) FILTER (created_at > TIMESTAMP '2001-01-01') AS grown FROM live WHERE project_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 100 AND count(*) FILTER (created_at > TIMESTAMP '2001-01-01') >= 10", NODES))
def describe_selection(g: GraphStore) -> DataFrame:
    return live(g.nodes()).filter("project_id IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("members"), F.count_if(F.col("created_at") > at("2001-01-01 00:00:00")).alias("grown")).filter("members >= 100 AND grown >= 10")


@query("g22_enrich_selection", sql("SELECT id, len(concepts)::BIGINT AS n FROM live WHERE len(concepts) <= 3 AND type = 'entity'", NODES))
def enrich_selection(g: GraphStore) -> DataFrame:
    return live(g.entities()).filter(F.size("concepts") <= 3).select("id", F.size("concepts").cast("bigint").alias("n"))


@query("g23_challenger_candidates", sql("SELECT n.id, coalesce(d, 0) AS in_degree FROM live n LEFT JOIN (SELECT target_id AS id, count(*) AS d FROM cur GROUP BY 1) USING (id) WHERE n.type = 'fact' AND n.id NOT IN (SELECT source_id FROM cur WHERE type = 'contradicts') ORDER BY 2, 1 LIMIT 100", NODES, EDGES))
def challenger_candidates(g: GraphStore) -> DataFrame:
    held = current(g.edges())
    degree = held.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))
    against = held.filter("type = 'contradicts'").select(F.col("source_id").alias("id")).distinct()
    return live(g.work()).filter("type = 'fact'").join(against, "id", "left_anti").join(degree, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree")).orderBy("in_degree", "id").limit(100)


@query("g24_conflict_pairs", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n, max(l_discount) AS similarity FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def conflict_pairs(g: GraphStore) -> DataFrame:
    """Unordered pairs, once each, with the highest similarity."""
    return g.table("lineitem").filter("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"), F.max("l_discount").alias("similarity"))


@query("g26_claims", "SELECT block, agent, event_id FROM (SELECT event_id % 100 AS block, user_id AS agent, event_id, row_number() OVER (PARTITION BY event_id % 100 ORDER BY ts, event_id) AS r FROM events WHERE ts > TIMESTAMP '2024-01-15') WHERE r = 1")
def claims(g: GraphStore) -> DataFrame:
    """The first claim of each block that has not run out."""
    e = g.table("events").filter(F.col("ts") > at("2024-01-15 00:00:00")).select((F.col("event_id") % 100).alias("block"), F.col("user_id").alias("agent"), "event_id", "ts")
    return e.groupBy("block").agg(F.min(F.struct("ts", "event_id", "agent")).alias("x")).select("block", "x.agent", "x.event_id")


@query("g27_heartbeats", "SELECT user_id AS agent, max(ts) AS last_ts, max(ts) >= TIMESTAMP '2024-01-30 18:00:00' AS active FROM events GROUP BY 1")
def heartbeats(g: GraphStore) -> DataFrame:
    return g.table("events").groupBy(F.col("user_id").alias("agent")).agg(F.max("ts").alias("last_ts")).withColumn("active", F.col("last_ts") >= at("2024-01-30 18:00:00"))


@query(
    "g28_next_tasks",
    sql("SELECT n.id, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::BIGINT AS level FROM live n WHERE n.type = 'task' AND n.work_status = 'open' AND NOT EXISTS (SELECT 1 FROM prompts p WHERE p.source_id = n.id AND p.target_id NOT IN (SELECT id FROM nodes WHERE work_status = 'done'))", NODES, EDGES),
)
def next_tasks(g: GraphStore) -> DataFrame:
    work = g.work()
    tasks = live(work).filter("type = 'task' AND work_status = 'open'").select("id", "priority", "created_at")
    needs = g.prompts().select(F.col("source_id").alias("id"), F.col("target_id").alias("needed"))
    return A.next_tasks(tasks, needs, work.filter("work_status = 'done'")).select("id", "level")


@query("g30_job_retention", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2001-07-30' THEN 'delete' WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-07-24' THEN 'delete' ELSE 'keep' END AS fate FROM orders")
def job_retention(g: GraphStore) -> DataFrame:
    made = F.col("o_orderdate")
    gone = ((F.col("o_orderstatus") == "F") & (made < at("2001-07-30 00:00:00"))) | ((F.col("o_orderstatus") == "P") & (made < at("2001-07-24 00:00:00")))
    return g.table("orders").select("o_orderkey", F.when(gone, "delete").otherwise("keep").alias("fate"))


@query("g31_scheduler_health", "SELECT user_id AS job, CASE WHEN max(CASE WHEN event_type = 'error' THEN ts END) >= TIMESTAMP '2024-01-30' THEN 'error' WHEN date_diff('second', max(ts), TIMESTAMP '2024-01-31') > 1.5 * 43200 THEN 'degraded' ELSE 'ok' END AS health FROM events GROUP BY 1")
def scheduler_health(g: GraphStore) -> DataFrame:
    """error: failed on the last day; degraded: silent for one and a half intervals of twelve hours."""
    failed = F.max(F.when(F.col("event_type") == "error", F.col("ts"))) >= at("2024-01-30 00:00:00")
    late = F.timestamp_diff("SECOND", F.max("ts"), at("2024-01-31 00:00:00")) > 1.5 * 43200
    return g.table("events").groupBy(F.col("user_id").alias("job")).agg(F.when(failed, "error").when(late, "degraded").otherwise("ok").alias("health"))


@query(
    "g32_alert_windows",
    "SELECT event_id, CASE WHEN n5 = 5 AND mean5 < 30 THEN 'quality_drop' WHEN before > 0 AND value > 2 * before AND value >= 100 THEN 'spike' ELSE 'none' END AS alert FROM (SELECT event_id, value, avg(value) OVER w5 AS mean5, count(*) OVER w5 AS n5, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))",
)
def alert_windows(g: GraphStore) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    five, before = w.rowsBetween(-4, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = g.table("events").select("event_id", "value", F.avg("value").over(five).alias("mean5"), F.count("*").over(five).alias("n5"), F.avg("value").over(before).alias("before"))
    alert = F.when((F.col("n5") == 5) & (F.col("mean5") < 30), "quality_drop").when((F.col("before") > 0) & (F.col("value") > 2 * F.col("before")) & (F.col("value") >= 100), "spike").otherwise("none")
    return rows.select("event_id", alert.alias("alert"))


@query(
    "g34_reminder_gate",
    "SELECT e.event_id, CASE WHEN r.ts IS NULL THEN 'never' WHEN date_diff('second', r.ts, e.ts) > 172800 THEN 'stale' ELSE 'fresh' END AS gate FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') r ON e.user_id = r.user_id AND e.ts >= r.ts",
)
def reminder_gate(g: GraphStore) -> DataFrame:
    """Each purchase against the user's last view: never, stale after two days, or fresh."""
    e = g.table("events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("ts").alias("last_view"))
    asof = H.latest_before(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "seen", "last_view")
    gate = F.when(F.col("last_view").isNull(), "never").when(F.timestamp_diff("SECOND", "last_view", "ts") > 172_800, "stale").otherwise("fresh")
    return asof.select("event_id", gate.alias("gate"))


# items


@query(
    "d01_twins",
    sql("SELECT id, winner, copies FROM (SELECT k.id, md5(norm) AS key, count(*) OVER (PARTITION BY norm) AS copies, (SELECT count(DISTINCT n2.type) FROM normal k2 JOIN notes n2 USING (id) WHERE k2.norm = k.norm) AS types, first_value(k.id) OVER (PARTITION BY norm ORDER BY (n.type = 'fact'), k.id) AS winner FROM normal k JOIN notes n USING (id)) WHERE types > 1", NOTES),
)
def twins(g: GraphStore) -> DataFrame:
    items = g.notes().select("id", "type", F.lit(0).alias("degree"), "essence")
    return I.twins(items, normal_text(F.col("essence")))


@query("d03_fold_facts", sql("SELECT n.id, r.source_id AS into FROM nodes n JOIN (SELECT target_id, any_value(source_id) AS source_id, any_value(type) AS type FROM (SELECT * FROM prompts UNION ALL SELECT * FROM evidence) GROUP BY 1 HAVING count(*) = 1) r ON r.target_id = n.id JOIN nodes s ON s.id = r.source_id WHERE n.type = 'fact' AND r.type = 'prompted_by' AND s.type IN ('decision', 'dead_end', 'constraint') AND n.id NOT IN (SELECT source_id FROM spine)", NODES, EDGES))
def fold_facts(g: GraphStore) -> DataFrame:
    refs = spine(g).select("source_id", "target_id", F.when(F.col("type") == "prompted_by", "based_on").otherwise("other").alias("type"))
    return I.folds(refs, g.work().select("id", "type"))


@query("d04_primary_value", sql("SELECT id, md5(trim(CASE WHEN type IN ('fact', 'constraint') AND trim(essence) <> '' THEN essence ELSE project_id END)) AS digest FROM notes", NOTES))
def primary_values(g: GraphStore) -> DataFrame:
    payload = F.map_from_arrays(F.array(F.lit("a_source"), F.when(F.col("type") == "constraint", "requirement").otherwise("value")), F.array(F.col("project_id"), F.coalesce("essence", F.lit(""))))
    kind = F.when(F.col("type").isin("fact", "constraint"), F.col("type")).otherwise("note")
    return g.notes().select("id", F.md5(I.primary_value(kind, payload)).alias("digest"))


@query("d05_first_occurrence", sql("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY source, norm) AS first, doc_id <> min(doc_id) OVER (PARTITION BY source, norm) AS repeat FROM normal JOIN documents USING (doc_id) WHERE norm <> ''", NOTES))
def first_occurrence(g: GraphStore) -> DataFrame:
    d = g.table("documents").select(F.col("doc_id").alias("id"), "source", F.md5(normal_text(F.col("text"))).alias("value")).filter(F.col("value") != F.md5(F.lit("")))
    return I.first_of(d, ["source", "value"], [F.col("id")]).select("id", "first", "repeat")


@query("d06_cross_group_merge", sql("SELECT type, md5(norm) AS digest, min(doc_id) AS survivor, string_agg(source, ',' ORDER BY source) AS groups FROM (SELECT DISTINCT type, norm, source, min(n.doc_id) OVER (PARTITION BY type, norm) AS doc_id FROM normal k JOIN notes n USING (doc_id) JOIN documents USING (doc_id)) GROUP BY type, norm", NOTES))
def cross_group_merge(g: GraphStore) -> DataFrame:
    n = g.notes().select("type", F.md5(normal_text(F.col("essence"))).alias("digest"), "project_id", F.substring("id", 2, 20).cast("bigint").alias("k"))
    return n.groupBy("type", "digest").agg(F.min("k").alias("survivor"), F.array_join(F.array_sort(F.collect_set("project_id")), ",").alias("groups"))


@query("d14_arc_consolidation", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def arc_consolidation(g: GraphStore) -> DataFrame:
    """One transcript a conversation, its turns in order; a conversation is one row, as long as its turns."""
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    return g.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")).alias("digest"))


@query("d15_arc_ranges", "SELECT conv_id, min(turn) AS start_turn, max(turn) AS end_turn, count(*) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'system') WHERE r <= 4 GROUP BY 1 HAVING count(*) >= 2")
def arc_ranges(g: GraphStore) -> DataFrame:
    """The oldest four pending turns of each conversation that has two or more."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = g.table("conversations").filter("role <> 'system'").withColumn("r", F.row_number().over(w)).filter("r <= 4")
    return rows.groupBy("conv_id").agg(F.min("turn").alias("start_turn"), F.max("turn").alias("end_turn"), F.count("*").alias("turns")).filter("turns >= 2")


@query("d17_batches", "SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12)::BIGINT AS batch FROM documents")
def batches(g: GraphStore) -> DataFrame:
    return I.batched(g.table("documents").select("doc_id", "source"), "source", [F.col("doc_id")], 12)


@query("d19_rescue", sql("SELECT DISTINCT id FROM kept", EDGES, ctes="kept AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT s.target_id FROM kept k JOIN spine s ON s.source_id = k.id)", recursive=True))
def rescue(g: GraphStore) -> DataFrame:
    kept = g.table("orders").filter("o_orderstatus = 'O'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return I.rescued(g.work(), spine(g), kept)


@query(
    "d20_role_context",
    sql("SELECT id, side, string_agg(t || ':' || n, ' ' ORDER BY t || ':' || n) AS types FROM (SELECT id, side, t, count(*) AS n FROM (SELECT e.target_id AS id, 'needed_by' AS side, s.type AS t FROM (SELECT * FROM prompts UNION ALL SELECT * FROM evidence) e JOIN nodes s ON s.id = e.source_id UNION ALL SELECT e.source_id, 'builds_on', t.type FROM (SELECT * FROM prompts UNION ALL SELECT * FROM evidence) e JOIN nodes t ON t.id = e.target_id) GROUP BY 1, 2, 3) GROUP BY 1, 2", NODES, EDGES),
)
def role_context(g: GraphStore) -> DataFrame:
    return I.role_context(spine(g), g.work())


@query("d21_unlinked_items", "SELECT 'o' || o_orderkey AS id FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def unlinked_items(g: GraphStore) -> DataFrame:
    s = spine(g)
    ends = s.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return g.work().select("id").join(ends, "id", "left_anti")


@query("d23_excerpt_window", "SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(1, p - 20), 40) END AS excerpt FROM (SELECT doc_id, text, CASE WHEN contains(text, 'idiot') THEN strpos(text, 'idiot') WHEN contains(text, 'Licensed') THEN strpos(text, 'Licensed') ELSE strpos(text, ' the ') END AS p FROM documents)")
def excerpt_window(g: GraphStore) -> DataFrame:
    return g.table("documents").select("doc_id", I.window_around(F.col("text"), ["idiot", "Licensed", " the "], 40).alias("excerpt"))


@query("g19_schema_validate", sql("SELECT type, count(*) AS n, count(*) FILTER (type NOT IN ('fact')) AS missing, count(*) FILTER (type NOT IN ('fact', 'constraint')) AS extra FROM notes GROUP BY 1", NOTES))
def schema_validate(g: GraphStore) -> DataFrame:
    """Notes whose payload is a value and a reason, against their types' schemas."""
    second = F.when(F.col("type") == "fact", "why_matters").when(F.col("type") == "constraint", "reason").otherwise("unknown")
    first = F.when(F.col("type") == "constraint", "source").otherwise("value")
    payload = F.map_from_arrays(F.array(first, second), F.array("project_id", "label"))
    c = I.checked(F.col("type"), payload)
    return g.notes().groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.size(c["missing"]) > 0).alias("missing"), F.count_if(F.size(c["extras"]) > 0).alias("extra"))


# time


@query(
    "h03_sessions",
    "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events, round(sum(value), 4) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
)
def sessions(g: GraphStore) -> DataFrame:
    return H.sessions(g.table("events"), "user_id")


@query("h04_count_triggers", "SELECT user_id, event_id, r // 10 AS fired FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r % 10 = 0")
def count_triggers(g: GraphStore) -> DataFrame:
    return H.triggers(g.table("events"), "user_id", [F.col("ts"), F.col("event_id")], 10).select("user_id", "event_id", "fired")


@query(
    "h05_cooldown",
    "WITH RECURSIVE f AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT f.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 3 DAY) FROM f WHERE f.ts IS NOT NULL) SELECT user_id, count(ts) AS fired, max(ts) AS last_ts FROM f WHERE ts IS NOT NULL GROUP BY 1",
)
def cooldown(g: GraphStore) -> DataFrame:
    return H.cooled(g.table("events"), "user_id", "event_id", 3 * 86400).groupBy("user_id").agg(F.count("*").alias("fired"), F.max("ts").alias("last_ts"))


@query("h07_rolling_spend", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW), 4) AS spend, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW), 4) > 400 AS over_budget FROM events")
def rolling_spend(g: GraphStore) -> DataFrame:
    spend = F.round(H.rolling(g.table("events"), "user_id", 86400), 4)
    return g.table("events").select("event_id", spend.alias("spend")).withColumn("over_budget", F.col("spend") > 400)


@query("h09_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling(g: GraphStore) -> DataFrame:
    return g.table("events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("h10_session_gaps", "SELECT DISTINCT user_id, k FROM (SELECT user_id, json_extract(props, '$.k')::BIGINT AS k, event_type FROM events) a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND json_extract(b.props, '$.k')::BIGINT = a.k)")
def session_gaps(g: GraphStore) -> DataFrame:
    """What a user looked up but never saved."""
    e = g.table("events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.filter("event_type = 'view'").select("user_id", "k").distinct().join(e.filter("event_type = 'purchase'").select("user_id", "k").distinct(), ["user_id", "k"], "left_anti")


@query("e08_usage_summary", "SELECT event_type AS model, grouping(event_type)::BIGINT AS level, count(*) AS calls, round(sum(value), 4) AS cost, count(*) FILTER (value IS NULL) AS unpriced, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ROLLUP (event_type)")
def usage_summary(g: GraphStore) -> DataFrame:
    return g.table("events").withColumnRenamed("event_type", "model").rollup("model").agg(F.grouping("model").cast("bigint").alias("level"), F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("value").isNull()).alias("unpriced"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("e09_windowed_spend", "SELECT round(sum(value), 4) AS spend, count(*) AS calls FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11 12:00:00'")
def windowed_spend(g: GraphStore) -> DataFrame:
    return g.table("events").filter((F.col("ts") >= at("2024-01-10 00:00:00")) & (F.col("ts") <= at("2024-01-11 12:00:00"))).agg(F.round(F.sum("value"), 4).alias("spend"), F.count("*").alias("calls"))


@query("e10_token_cost", "SELECT event_id, round(value * 1000 / 1e6 * CASE event_type WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 15.0 WHEN 'view' THEN 0.0 END::DOUBLE, 6) AS usd FROM events")
def token_cost(g: GraphStore) -> DataFrame:
    rates = g.spark.createDataFrame([("click", 3.0), ("purchase", 15.0), ("view", 0.0)], "event_type string, rate double")
    return g.table("events").join(F.broadcast(rates), "event_type", "left").select("event_id", H.cost(F.col("value") * 1000, F.col("rate")).alias("usd"))


@query("e11_cost_breakdown", "SELECT user_id, CASE WHEN bool_or(event_type <> 'view' AND event_type = 'signup') THEN NULL ELSE round(sum(CASE WHEN event_type <> 'view' THEN value END), 4) END AS total FROM events GROUP BY 1")
def cost_breakdown(g: GraphStore) -> DataFrame:
    """Views did not run and are skipped; a signup has no cost, so its user's total is unknown."""
    usd = F.when(F.col("event_type") != "signup", F.col("value"))
    return g.table("events").groupBy("user_id").agg(F.round(H.poisoned_total(F.col("event_type") != "view", usd), 4).alias("total"))


@query("e23_drought", "SELECT event_id FROM (SELECT event_id, sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS low FROM events) WHERE low = 3")
def drought(g: GraphStore) -> DataFrame:
    """Events that end three low ones in a row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return g.table("events").select("event_id", F.sum((F.col("value") < 20).cast("int")).over(w).alias("low")).filter("low = 3").select("event_id")


@query("e27_billed_tokens", "SELECT event_type, sum(event_id % 1000)::BIGINT AS input, sum(event_id % 100)::BIGINT AS thinking, sum(event_id % 10)::BIGINT AS output, sum(event_id % 1000 + 23 * (event_id % 100) + event_id % 10)::BIGINT AS billed FROM events GROUP BY 1")
def billed_tokens(g: GraphStore) -> DataFrame:
    k = F.col("event_id")
    return g.table("events").groupBy("event_type").agg(F.sum(k % 1000).alias("input"), F.sum(k % 100).alias("thinking"), F.sum(k % 10).alias("output"), F.sum(k % 1000 + 23 * (k % 100) + k % 10).alias("billed"))
