"""Queries over scans, lists and roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import reads as R
from ..sources.graph import GraphStore, at, current, live, now
from .prelude import EDGES, NODES, NOTES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


@query("a02_live_nodes", sql("SELECT type, status, count(*) AS n, sum(access_count)::BIGINT AS accesses FROM live GROUP BY ALL", NODES))
def live_nodes(g: GraphStore) -> DataFrame:
    return live(g.nodes()).groupBy("type", "status").agg(F.count("*").alias("n"), F.sum("access_count").alias("accesses"))


@query("a03_by_status", sql("SELECT id, label, updated_at FROM nodes WHERE status = 'archived'", NODES))
def by_status(g: GraphStore) -> DataFrame:
    return R.listed(g.nodes(), status="archived").select("id", "label", "updated_at")


@query("a04_edges_as_of", sql("SELECT type, count(*) AS n FROM edges WHERE created_at <= TIMESTAMP '2000-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2000-01-01') GROUP BY type", EDGES))
def edges_as_of(g: GraphStore) -> DataFrame:
    return current(g.edges(), at("2000-01-01 00:00:00")).groupBy("type").agg(F.count("*").alias("n"))


@query("a04_current_edges", sql("SELECT type, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM cur GROUP BY type", EDGES))
def current_edges(g: GraphStore) -> DataFrame:
    return current(g.edges()).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query("a05_point_lookup", sql("SELECT id, label, type, project_id FROM nodes WHERE id = 'ORDER_7' OR lower(label) = 'order_7'", NODES))
def point_lookup(g: GraphStore) -> DataFrame:
    return R.by_key(g.nodes(), "ORDER_7").select("id", "label", "type", "project_id")


@query("a06_recent", sql("SELECT id, updated_at FROM live WHERE project_id = 'n3' ORDER BY updated_at DESC, id LIMIT 25", NODES))
def recent(g: GraphStore) -> DataFrame:
    return R.listed(g.nodes(), project="n3", limit=25).select("id", "updated_at")


@query("a06_missing_vectors", sql("SELECT id, label, updated_at FROM live WHERE type = 'artifact' AND id NOT IN (SELECT 'p' || vec_id FROM embeddings WHERE embedding IS NOT NULL)", NODES))
def missing_vectors(g: GraphStore) -> DataFrame:
    """Live parts that have no vector yet."""
    have = g.table("embeddings").filter("embedding IS NOT NULL").select(F.concat(F.lit("p"), "vec_id").alias("id"))
    return live(g.artifacts()).join(have, "id", "left_anti").select("id", "label", "updated_at")


@query(
    "a09_turn_normaliser",
    sql("SELECT conv_id, turn, role, length(clip)::BIGINT AS kept_chars, md5(clip) AS digest FROM (SELECT *, left(trim(text), CASE role WHEN 'user' THEN 2000 ELSE 16000 END) AS clip FROM conversations) WHERE length(clip) >= 10"),
)
def turn_normaliser(g: GraphStore) -> DataFrame:
    from ..sources.turns import normalised

    return normalised(g.table("conversations")).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("kept_chars"), F.md5("text").alias("digest"))


@query(
    "a11_export_json",
    sql(
        "SELECT n.id, n.type, n.label, coalesce(count(e.target_id), 0) AS links, coalesce(string_agg(e.type || ':' || e.target_id, ',' ORDER BY e.type, e.target_id), '') AS outgoing FROM live n LEFT JOIN (SELECT DISTINCT source_id, target_id, type FROM cur WHERE target_id IN (SELECT id FROM live)) e ON e.source_id = n.id WHERE n.type IN ('task', 'project') GROUP BY 1, 2, 3",
        NODES,
        EDGES,
    ),
)
def export_json(g: GraphStore) -> DataFrame:
    known = live(g.nodes())
    out = current(g.edges()).select("source_id", "target_id", "type").distinct().join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    links = out.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("links"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", "target_id"))), ",").alias("outgoing"))
    return known.filter(F.col("type").isin("task", "project")).join(links, "id", "left").select("id", "type", "label", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("outgoing", F.lit("")).alias("outgoing"))


@query("a13_artifact_tiering", sql("SELECT page_id, strlen(html)::BIGINT AS bytes, CASE WHEN strlen(html) <= 8192 THEN 'inline' WHEN strlen(html) <= 5242880 THEN 'file' ELSE 'reference' END AS tier, left(sha256(html), 16) AS digest FROM pages"))
def artifact_tiering(g: GraphStore) -> DataFrame:
    size = F.octet_length("html")
    return g.table("pages").select("page_id", size.cast("bigint").alias("bytes"), F.when(size <= 8192, "inline").when(size <= 5_242_880, "file").otherwise("reference").alias("tier"), F.substring(F.sha2("html", 256), 1, 16).alias("digest"))


@query("b01_list_filters", sql("SELECT id, label, type, project_id FROM nodes WHERE type = 'task' AND status = 'active' AND created_at >= TIMESTAMP '1998-01-01' AND work_status = 'open' AND len(list_filter(concepts, lambda c: contains(lower(c), 'high'))) > 0 AND label LIKE 'order\\_%' ESCAPE '\\' AND (contains(lower(label), '2') OR contains(lower(essence), '2'))", NODES))
def list_filters(g: GraphStore) -> DataFrame:
    return R.listed(g.nodes(), type="task", status="active", since=at("1998-01-01 00:00:00"), work_status="open", concept="high", label_prefix="order_", text="2").select("id", "label", "type", "project_id")


@query(
    "b04_scoped_list",
    sql(
        "SELECT p.id AS scope, count(t.id) AS own, (SELECT count(*) FROM live x JOIN nodes c ON x.project_id = c.id WHERE c.project_id = p.id AND x.type = 'task') AS below FROM nodes p LEFT JOIN live t ON t.project_id = p.id AND t.type = 'task' WHERE p.type = 'project' GROUP BY p.id",
        NODES,
    ),
)
def scoped_list(g: GraphStore) -> DataFrame:
    """Tasks of each project, and of the projects right below it."""
    roots = g.roots().select(F.col("id").alias("scope"), F.col("project_id").alias("parent"))
    own = live(g.work()).filter("type = 'task'").groupBy(F.col("project_id").alias("scope")).agg(F.count("*").alias("own"))
    counted = roots.join(own, "scope", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    below = counted.groupBy(F.col("parent").alias("scope")).agg(F.sum("own").alias("below"))
    return counted.join(below, "scope", "left").select("scope", "own", F.coalesce("below", F.lit(0)).alias("below"))


@query(
    "b05_block_read",
    sql(
        "SELECT n.id, n.label, e.type, e.target_id, CASE WHEN length(t.essence) > 8 THEN rtrim(left(t.essence, 8)) || '…' ELSE t.essence END AS gist FROM live n JOIN cur e ON e.source_id = n.id JOIN nodes t ON t.id = e.target_id WHERE n.project_id = 'n7' AND e.type <> 'part_of'",
        NODES,
        EDGES,
    ),
)
def block_read(g: GraphStore) -> DataFrame:
    from ..functions.text import gist

    nodes = g.nodes()
    n = live(nodes).filter("project_id = 'n7'").select("id", "label")
    t = nodes.select(F.col("id").alias("target_id"), gist(F.col("essence"), 8).alias("gist"))
    e = current(g.edges()).filter("type <> 'part_of'").select(F.col("source_id").alias("id"), "target_id", "type")
    return n.join(e, "id").join(t, "target_id").select("id", "label", "type", "target_id", "gist")


@query(
    "b06_derivation_staleness",
    sql("SELECT e.source_id AS id, count(*) AS inputs, count(*) FILTER (t.updated_at > s.created_at) AS newer_inputs FROM cur e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.type = 'based_on' GROUP BY 1 HAVING count(*) FILTER (t.updated_at > s.created_at) > 0", NODES, EDGES),
)
def derivation_staleness(g: GraphStore) -> DataFrame:
    """Nodes that an input of theirs outdates."""
    work = g.work()
    made = work.select(F.col("id").alias("source_id"), F.col("created_at").alias("made_at"))
    inputs = work.select(F.col("id").alias("target_id"), "updated_at")
    pairs = current(g.evidence()).select("source_id", "target_id").join(made, "source_id").join(inputs, "target_id")
    return pairs.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("inputs"), F.count_if(F.col("updated_at") > F.col("made_at")).alias("newer_inputs")).filter("newer_inputs > 0")


@query("b08_history", sql("SELECT event_id, user_id, event_type, ts FROM events WHERE user_id = 5 AND ts >= TIMESTAMP '2024-01-10' AND event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 50"))
def history(g: GraphStore) -> DataFrame:
    """Changes by one actor since a time, newest first; conditions hold before the limit."""
    return g.table("events").filter((F.col("user_id") == 5) & (F.col("ts") >= at("2024-01-10 00:00:00")) & (F.col("event_type") != "view")).orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "user_id", "event_type", "ts")


@query("b10_relations_list", sql("SELECT e.source_id, e.target_id, e.type, s.label AS source_label, t.label AS target_label FROM cur e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.type = 'based_on'", NODES, EDGES))
def relations_list(g: GraphStore) -> DataFrame:
    nodes = g.nodes()
    return R.with_ends(current(g.edges()).filter("type = 'based_on'").select("source_id", "target_id", "type"), nodes)


@query(
    "b12_incoming_inverse",
    sql("SELECT seen_as, count(*) AS n, count(DISTINCT target_id) AS nodes FROM (SELECT target_id, CASE type WHEN 'part_of' THEN 'contains' WHEN 'prompted_by' THEN 'triggered' WHEN 'affects' THEN 'affected_by' ELSE type END AS seen_as FROM cur) GROUP BY 1", EDGES),
)
def incoming_inverse(g: GraphStore) -> DataFrame:
    return R.incoming(g.edges()).groupBy("seen_as").agg(F.count("*").alias("n"), F.countDistinct("id").alias("nodes"))


@query(
    "b13_nav_card",
    sql("SELECT * FROM (SELECT project_id AS id, id AS child, label, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) AS place FROM live WHERE project_id IS NOT NULL) WHERE place <= 8", NODES),
)
def nav_card(g: GraphStore) -> DataFrame:
    children = live(g.nodes()).filter("project_id IS NOT NULL").select(F.col("project_id").alias("id"), F.col("id").alias("child"), "label", "updated_at")
    return R.top_in_group(children, ["id"], [F.col("updated_at").desc(), F.col("child")], 8).drop("updated_at")


@query("b14_graph_dump", sql("SELECT e.type, count(*) AS n FROM cur e SEMI JOIN live a ON e.source_id = a.id SEMI JOIN live b ON e.target_id = b.id GROUP BY 1", NODES, EDGES))
def graph_dump(g: GraphStore) -> DataFrame:
    ids = live(g.nodes()).select("id")
    e = current(g.edges())
    return e.join(ids, e.source_id == ids.id, "left_semi").join(ids, e.target_id == ids.id, "left_semi").groupBy("type").agg(F.count("*").alias("n"))


@query("b15_conflicts", sql("SELECT e.source_id, e.target_id, s.label AS source_label, t.label AS target_label, count(*) AS n FROM cur e JOIN live s ON s.id = e.source_id JOIN live t ON t.id = e.target_id WHERE e.type = 'contradicts' AND t.project_id = 'n4' GROUP BY ALL", NODES, EDGES))
def conflicts(g: GraphStore) -> DataFrame:
    nodes = live(g.nodes())
    found = current(g.supplies()).filter("type = 'contradicts'").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    in_scope = nodes.filter("project_id = 'n4'")
    return found.join(nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source_label")), "source_id").join(in_scope.select(F.col("id").alias("target_id"), F.col("label").alias("target_label")), "target_id")


@query(
    "b16_inject_pack",
    sql("SELECT 'dead_ends' AS section, id, updated_at FROM live WHERE project_id = 'n2' AND type = 'dead_end' UNION ALL SELECT 'constraints', id, updated_at FROM live WHERE project_id = 'n2' AND type = 'constraint' UNION ALL SELECT 'open_tasks', id, updated_at FROM live WHERE project_id = 'n2' AND type = 'task' AND work_status = 'open'", NODES),
)
def inject_pack(g: GraphStore) -> DataFrame:
    section = F.when(F.col("type") == "dead_end", "dead_ends").when(F.col("type") == "constraint", "constraints").when((F.col("type") == "task") & (F.col("work_status") == "open"), "open_tasks")
    return live(g.nodes()).filter("project_id = 'n2'").withColumn("section", section).filter("section IS NOT NULL").select("section", "id", "updated_at")


@query(
    "b17_session_overview",
    sql("SELECT count(*) FILTER (type = 'project') AS projects, count(*) FILTER (type = 'task' AND work_status <> 'done') AS open_tasks, count(*) FILTER (project_id IS NULL AND type <> 'project') AS unlinked, count(*) AS nodes, max(updated_at) AS newest FROM live", NODES),
)
def session_overview(g: GraphStore) -> DataFrame:
    kind = F.col("type")
    return live(g.nodes()).agg(
        F.count_if(kind == "project").alias("projects"), F.count_if((kind == "task") & (F.col("work_status") != "done")).alias("open_tasks"), F.count_if(F.col("project_id").isNull() & (kind != "project")).alias("unlinked"), F.count("*").alias("nodes"), F.max("updated_at").alias("newest")
    )


@query(
    "b18_expand_neighbours",
    sql(
        "SELECT e.source_id AS id, t.id AS other, round(least(1.0, t.quality / 6.0 * 1.2) / (1 + date_diff('second', t.updated_at, TIMESTAMP '2024-02-01') / 86400.0 * 0.01), 6) AS score FROM (SELECT DISTINCT source_id, target_id FROM cur WHERE type IN ('prompted_by', 'based_on', 'extends', 'supports', 'related_to')) e JOIN live t ON t.id = e.target_id",
        NODES,
        EDGES,
    ),
)
def expand_neighbours(g: GraphStore) -> DataFrame:
    from ..functions.scoring import recency

    hops = current(g.prompts().unionByName(g.evidence())).select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).distinct()
    t = live(g.work()).select(F.col("id").alias("other"), F.round(F.least(F.lit(1.0), F.col("quality") / 6.0 * 1.2) * recency(F.col("updated_at"), F.lit("project"), now()), 6).alias("score"))
    return hops.join(t, "other").select("id", "other", "score")


@query("b19_turn_range", sql("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations WHERE turn BETWEEN 1 AND 4 GROUP BY 1"))
def turn_range(g: GraphStore) -> DataFrame:
    return g.table("conversations").filter(F.col("turn").between(1, 4)).groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"))


@query("b07_review_queue", sql("SELECT id, project_id, quality, label FROM notes WHERE quality <= 2 AND project_id = 'src1'", NOTES))
def review_queue(g: GraphStore) -> DataFrame:
    return g.notes().filter("quality <= 2 AND project_id = 'src1'").select("id", "project_id", "quality", "label")


@query("e01_stats", sql("SELECT type, status, grouping(type, status)::BIGINT AS level, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((type), (status), ())", NODES))
def stats(g: GraphStore) -> DataFrame:
    """Counts by type, by status and in all, in one pass."""
    return g.nodes().groupingSets([["type"], ["status"], []], "type", "status").agg(F.grouping_id("type", "status").alias("level"), F.count("*").alias("n"))


@query("e02_in_degree", sql("SELECT target_id AS id, count(*) AS in_degree FROM cur GROUP BY 1", EDGES))
def in_degree(g: GraphStore) -> DataFrame:
    return R.in_degree(g.edges())


@query("e03_recall_precision", sql("SELECT user_id AS id, count(*) AS recalled, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END)::BIGINT AS used, round(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) / count(*), 2) AS precision FROM events GROUP BY 1 ORDER BY 4 DESC, 2 DESC, 1 LIMIT 20"))
def recall_precision(g: GraphStore) -> DataFrame:
    used = F.sum(F.col("event_type").isin("click", "purchase").cast("bigint"))
    return g.table("events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("recalled"), used.alias("used"), F.round(used / F.count("*"), 2).alias("precision")).orderBy(F.desc("precision"), F.desc("recalled"), "id").limit(20)


@query("e04_inactive_agents", sql("SELECT user_id AS agent, max(ts) AS last_ts FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' ORDER BY last_ts, agent LIMIT 16"))
def inactive_agents(g: GraphStore) -> DataFrame:
    return g.table("events").groupBy(F.col("user_id").alias("agent")).agg(F.max("ts").alias("last_ts")).filter(F.col("last_ts") < at("2024-01-30 12:00:00")).orderBy("last_ts", "agent").limit(16)


@query("e05_failed_agents", sql("SELECT DISTINCT user_id AS agent FROM events WHERE event_type = 'error' AND value > 100"))
def failed_agents(g: GraphStore) -> DataFrame:
    return g.table("events").filter("event_type = 'error' AND value > 100").select(F.col("user_id").alias("agent")).distinct()


@query("e06_flag_summary", sql("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS unreviewed, count(DISTINCT user_id) AS writers FROM events GROUP BY event_type"))
def flag_summary(g: GraphStore) -> DataFrame:
    return g.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("unreviewed"), F.countDistinct("user_id").alias("writers"))


@query("e13_session_report", sql("SELECT type, count(*) AS n, count(*) FILTER (quality = 1) AS q1, count(*) FILTER (quality = 2) AS q2, count(*) FILTER (quality = 3) AS q3, count(*) FILTER (quality = 4) AS q4, count(*) FILTER (quality >= 5) AS q5, round(avg(quality), 4) AS mean_quality, round(100.0 * count(*) FILTER (updated_at > created_at) / count(*), 2) AS update_pct FROM live GROUP BY type", NODES))
def session_report(g: GraphStore) -> DataFrame:
    q = F.least(F.greatest("quality", F.lit(1)), F.lit(5))
    return live(g.nodes()).groupBy("type").agg(F.count("*").alias("n"), *(F.count_if(q == k).alias(f"q{k}") for k in range(1, 6)), F.round(F.avg("quality"), 4).alias("mean_quality"), F.round(F.lit(100.0) * F.count_if(F.col("updated_at") > F.col("created_at")) / F.count("*"), 2).alias("update_pct"))


@query("e14_agents_with_counts", sql("SELECT c_custkey AS agent, c_mktsegment AS role, count(o_orderkey) AS blocks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"))
def agents_with_counts(g: GraphStore) -> DataFrame:
    made = g.table("orders").groupBy(F.col("o_custkey").alias("agent")).agg(F.count("*").alias("blocks"))
    return g.table("customer").select(F.col("c_custkey").alias("agent"), F.col("c_mktsegment").alias("role")).join(made, "agent", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))


@query(
    "e15_freshness",
    sql("SELECT conv_id, last_turn, n, role AS modal_role FROM (SELECT conv_id, role, count(*) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, role) AS r FROM conversations GROUP BY 1, 2) JOIN (SELECT conv_id, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id) WHERE r = 1"),
)
def freshness(g: GraphStore) -> DataFrame:
    """Span and most frequent role of each conversation; of equal counts the first by name."""
    by_role = g.table("conversations").groupBy("conv_id", "role").agg(F.count("*").alias("c"), F.max("turn").alias("t"))
    return by_role.groupBy("conv_id").agg(F.max("t").alias("last_turn"), F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), "role"))["role"].alias("modal_role"))


@query("e16_conversation_summary", sql("SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'system') AS system_turns, arg_max(md5(text), turn) AS last_digest FROM conversations GROUP BY 1"))
def conversation_summary(g: GraphStore) -> DataFrame:
    c = g.table("conversations")
    return c.groupBy("conv_id").agg(*(F.count_if(F.col("role") == r).alias(f"{r}_turns") for r in ("user", "assistant", "system")), F.max_by(F.md5("text"), "turn").alias("last_digest"))


@query("e17_quality_score", sql("SELECT id, least(5, 1 + (type IS NOT NULL)::INT + (len(concepts) >= 2)::INT + (len(concepts) >= 3)::INT + (type = 'project')::INT)::BIGINT AS score FROM live WHERE type <> 'entity'", NODES))
def quality_score(g: GraphStore) -> DataFrame:
    n = F.size("concepts")
    return live(g.nodes()).filter("type <> 'entity'").select("id", R.quality(F.col("type").isNotNull(), n, n, F.col("type") == "project").alias("score"))


@query("e18_quality_with_edges", sql("SELECT n.id, least(5, 1 + (type IS NOT NULL)::INT + (len(concepts) >= 2)::INT + (len(concepts) >= 3)::INT + (coalesce(d, 0) > 0)::INT)::BIGINT AS score FROM live n LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM cur UNION ALL SELECT target_id FROM cur) GROUP BY 1) USING (id)", NODES, EDGES))
def quality_with_edges(g: GraphStore) -> DataFrame:
    held = current(g.edges())
    degree = held.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    n = F.size("concepts")
    return live(g.nodes()).join(degree, "id", "left").select("id", R.quality(F.col("type").isNotNull(), n, n, F.col("d") > 0).alias("score"))


@query(
    "e19_staleness",
    sql("SELECT id, days, CASE WHEN days > 1000 THEN 'archive' WHEN days > 600 THEN 'review' ELSE 'keep' END AS advice FROM (SELECT id, round(date_diff('second', updated_at, TIMESTAMP '2024-02-01') / 86400.0 / ln(access_count + 2), 1) AS days FROM live WHERE status = 'active' AND type <> 'project') WHERE days > 500", NODES),
)
def staleness(g: GraphStore) -> DataFrame:
    days = F.col("days")
    found = live(g.nodes()).filter("status = 'active' AND type <> 'project'").select("id", R.staleness(F.col("updated_at"), F.col("access_count"), now()).alias("days")).filter(days > 500)
    return found.withColumn("advice", F.when(days > 1000, "archive").when(days > 600, "review").otherwise("keep"))


@query("e20_resume_briefing", sql("SELECT project_id, count(*) FILTER (type = 'task' AND work_status = 'open') AS open_tasks, count(*) FILTER (created_at > TIMESTAMP '2000-06-01') AS new_since, count(*) FILTER (created_at <= TIMESTAMP '2000-06-01' AND updated_at > TIMESTAMP '2000-06-01') AS updated_since, count(*) FILTER (type = 'decision') AS decisions FROM live WHERE project_id IS NOT NULL GROUP BY 1", NODES))
def resume_briefing(g: GraphStore) -> DataFrame:
    since = at("2000-06-01 00:00:00")
    made, changed, kind = F.col("created_at"), F.col("updated_at"), F.col("type")
    return live(g.nodes()).filter("project_id IS NOT NULL").groupBy("project_id").agg(F.count_if((kind == "task") & (F.col("work_status") == "open")).alias("open_tasks"), F.count_if(made > since).alias("new_since"), F.count_if((made <= since) & (changed > since)).alias("updated_since"), F.count_if(kind == "decision").alias("decisions"))


@query("e21_top_k", sql("SELECT id, access_count, updated_at FROM live ORDER BY access_count DESC, updated_at DESC, id LIMIT 30", NODES))
def top_k(g: GraphStore) -> DataFrame:
    return live(g.nodes()).orderBy(F.desc("access_count"), F.desc("updated_at"), "id").limit(30).select("id", "access_count", "updated_at")


@query("e22_rank_in_group", sql("SELECT * FROM (SELECT project_id, id, quality, row_number() OVER (PARTITION BY project_id ORDER BY quality DESC, updated_at DESC, id) AS place FROM live WHERE type = 'decision') WHERE place <= 3", NODES))
def rank_in_group(g: GraphStore) -> DataFrame:
    return R.top_in_group(live(g.work()).filter("type = 'decision'").select("project_id", "id", "quality", "updated_at"), ["project_id"], [F.desc("quality"), F.desc("updated_at"), F.col("id")], 3).drop("updated_at")


@query("e28_recent_window", sql("SELECT id, created_at FROM notes WHERE created_at >= TIMESTAMP '2024-01-01 12:00:00' AND created_at < TIMESTAMP '2024-01-01 16:00:00'", NOTES))
def recent_window(g: GraphStore) -> DataFrame:
    return g.notes().filter((F.col("created_at") >= at("2024-01-01 12:00:00")) & (F.col("created_at") < at("2024-01-01 16:00:00"))).select("id", "created_at")


@query("g05_unlinked", sql("SELECT id, type FROM nodes WHERE status = 'created' AND type <> 'project' AND project_id IS NULL", NODES))
def unlinked(g: GraphStore) -> DataFrame:
    return g.nodes().filter("status = 'created' AND type <> 'project' AND project_id IS NULL").select("id", "type")
