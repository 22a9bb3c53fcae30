"""Further reads, pipeline seams and routing rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard, scope_segment, terms
from ..operators import cells
from ..operators import reads as R
from ..operators import search as S
from ..operators import temporal
from ..operators.grams import similar_tags
from ..operators.intervals import in_intervals, micros
from ..sources.graph import GraphStore, at, current, live, normal_text
from .prelude import EDGES, NODES, NOTES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


@query("a10_capture_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'transient' ELSE 'unknown' END AS class, o_orderstatus = 'F' AS advances FROM orders")
def capture_status(g: GraphStore) -> DataFrame:
    """Whether a status is final, so that the reading position moves on."""
    s = F.col("o_orderstatus")
    return g.table("orders").select("o_orderkey", F.when(s == "F", "final").when(s == "P", "transient").otherwise("unknown").alias("class"), (s == "F").alias("advances"))


@query("b02_detail_levels", sql("SELECT id, type, label, CASE WHEN type = 'task' THEN essence END AS content, CASE WHEN type = 'task' THEN array_to_string(concepts, ',') END AS concepts FROM live WHERE type IN ('task', 'dead_end')", NODES))
def detail_levels(g: GraphStore) -> DataFrame:
    """Tasks in full, dead ends on the surface."""
    full = F.col("type") == "task"
    return live(g.work()).filter(F.col("type").isin("task", "dead_end")).select("id", "type", "label", F.when(full, F.col("essence")).alias("content"), F.when(full, F.array_join("concepts", ",")).alias("concepts"))


@query("b09_write_log", "SELECT event_id, ts, event_type FROM events WHERE event_type IN ('click', 'error') ORDER BY ts DESC, event_id LIMIT 200")
def write_log(g: GraphStore) -> DataFrame:
    return g.table("events").filter(F.col("event_type").isin("click", "error")).orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "ts", "event_type")


@query("b11_node_edges", sql("SELECT id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM cur UNION ALL SELECT target_id, 0, 1 FROM cur WHERE type = 'contradicts') GROUP BY 1", EDGES))
def node_edges(g: GraphStore) -> DataFrame:
    """Outgoing edges, and incoming ones of types that hold both ways."""
    e = current(g.edges())
    out = e.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    back = e.filter("type = 'contradicts'").select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(back).groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


@query("b21_quarantine", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 40 THEN 'too_short' ELSE 'symbols' END AS reason FROM documents WHERE text IS NULL OR length(text) < 40 OR contains(text, '%%%')")
def quarantine(g: GraphStore) -> DataFrame:
    text = F.col("text")
    bad = text.isNull() | (F.length(text) < 40) | F.contains(text, F.lit("%%%"))
    return g.table("documents").filter(bad).select("doc_id", F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.length(text) < 40, "too_short").otherwise("symbols").alias("reason"))


@query("b22_project_status", sql("SELECT project_id, id, updated_at, place FROM (SELECT project_id, id, updated_at, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) AS place FROM live WHERE project_id IS NOT NULL AND type = 'fact') WHERE place <= 5", NODES))
def project_status(g: GraphStore) -> DataFrame:
    return R.top_in_group(live(g.work()).filter("type = 'fact'").select("project_id", "id", "updated_at"), ["project_id"], [F.desc("updated_at"), F.col("id")], 5)


@query("c09_currency_names", sql("SELECT type, CASE type WHEN 'dead_end' THEN 'resolved_by' ELSE 'superseded_by' END AS meaning, count(*) AS n FROM live GROUP BY 1, 2", NODES))
def currency_names(g: GraphStore) -> DataFrame:
    return live(g.nodes()).select("type", F.when(F.col("type") == "dead_end", "resolved_by").otherwise("superseded_by").alias("meaning")).groupBy("type", "meaning").agg(F.count("*").alias("n"))


@query(
    "c19_value_overlap",
    r"SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6)::DOUBLE AS overlap FROM (SELECT conv_id, turn, list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')) AS a0, lag(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b0, list_filter(a0, lambda x: length(x) >= 3) AS a, list_filter(b0, lambda x: length(x) >= 3) AS b FROM conversations) WHERE b IS NOT NULL",
)
def value_overlap(g: GraphStore) -> DataFrame:
    """Share of words that a turn has in common with the one before."""
    c = g.table("conversations").select("conv_id", "turn", terms(F.col("text")).alias("a"))
    c = c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b IS NOT NULL")
    return c.select("conv_id", "turn", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("c19_scope_segments", sql("SELECT split_part(label, '_', 1) AS scope, count(*) AS n FROM live GROUP BY 1 HAVING count(*) > 1", NODES))
def scope_segments(g: GraphStore) -> DataFrame:
    return live(g.nodes()).groupBy(scope_segment(F.col("label")).alias("scope")).agg(F.count("*").alias("n")).filter("n > 1")


@query(
    "c21_vocabulary_hints",
    sql(
        "SELECT a.c AS tag, b.c AS known, row_number() OVER (PARTITION BY a.c ORDER BY b.c) AS place FROM v a JOIN v b ON a.c <> b.c AND (starts_with(b.c, left(a.c, 5)) OR starts_with(a.c, left(b.c, 5)) OR contains(b.c, left(a.c, 6)) OR contains(a.c, left(b.c, 6))) QUALIFY place <= 2",
        NODES,
        ctes="v AS (SELECT DISTINCT unnest(concepts) AS c FROM live UNION SELECT DISTINCT unnest(string_split(lower(name), '#')) FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier))",
    ),
)
def vocabulary_hints(g: GraphStore) -> DataFrame:
    """Up to two known tags for each tag that begin like it or contain it, tags being concepts and the parts of entities' names."""
    names = live(g.entities()).select(F.explode(F.split(F.lower("essence"), "#")).alias("tag"))
    tags = live(g.nodes()).select(F.explode("concepts").alias("tag")).unionByName(names).distinct()
    return similar_tags(tags, tags.withColumnRenamed("tag", "known"))


@query("d02_value_sets", sql("SELECT key, min(id) AS winner, count(*) AS copies FROM (SELECT id, array_to_string(list_sort(list_distinct(concepts)), '|') AS key FROM live WHERE type = 'artifact') GROUP BY 1 HAVING count(*) > 1", NODES))
def value_sets(g: GraphStore) -> DataFrame:
    """Items with the same set of values, whatever their order."""
    keyed = live(g.artifacts()).select("id", F.array_join(F.array_sort(F.array_distinct("concepts")), "|").alias("key"))
    return keyed.groupBy("key").agg(F.min("id").alias("winner"), F.count("*").alias("copies")).filter("copies > 1")


@query("d07_drifted_ids", "SELECT a.o_orderkey AS id, b.o_orderkey AS twin FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') a JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') b USING (o_custkey, o_orderpriority, k)")
def drifted_ids(g: GraphStore) -> DataFrame:
    """The k-th of one kind is matched with the k-th of the other."""
    k = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    side = lambda s, name: g.table("orders").filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority", k.alias("k"), F.col("o_orderkey").alias(name))
    return side("O", "id").join(side("F", "twin"), ["o_custkey", "o_orderpriority", "k"]).select("id", "twin")


@query("d11_ungrounded", sql("SELECT id FROM live WHERE type = 'decision' AND id NOT IN (SELECT source_id FROM evidence)", NODES, EDGES))
def ungrounded(g: GraphStore) -> DataFrame:
    return live(g.work()).filter("type = 'decision'").select("id").join(g.evidence().select(F.col("source_id").alias("id")), "id", "left_anti")


@query("d13_first_mapping", sql("SELECT DISTINCT norm_md5 AS value, first_value(project_id) OVER (PARTITION BY norm_md5 ORDER BY doc_id) AS root FROM (SELECT md5(norm) AS norm_md5, project_id, n.doc_id FROM normal k JOIN notes n USING (doc_id))", NOTES))
def first_mapping(g: GraphStore) -> DataFrame:
    """A value's root is that of its first item."""
    n = g.notes().select(F.md5(normal_text(F.col("essence"))).alias("value"), "project_id", F.substring("id", 2, 20).cast("bigint").alias("k"))
    return n.groupBy("value").agg(F.min_by("project_id", "k").alias("root"))


@query(
    "d16_duplicate_alerts",
    "WITH s AS (SELECT a.vec_id, b.vec_id AS other, a.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT vec_id, arg_max(other, (round(sim, 6), -other)) AS nearest, CASE WHEN max(sim) >= 0.88 THEN 'strong' WHEN max(sim) >= 0.72 THEN 'related' ELSE 'none' END AS alert FROM s GROUP BY 1",
)
def duplicate_alerts(g: GraphStore) -> DataFrame:
    """The nearest vector of the same label of every vector whose id is divisible by 50, and how near; equal ones, to six digits, by id."""
    v = g.table("embeddings")
    best = cells.closest(cells.indexed(v, group="label"), v.filter("vec_id % 50 = 0"), 6, group="label")
    m = F.col("similarity")
    return best.select(F.col("query_id").alias("vec_id"), F.col("id").alias("nearest"), F.when(m >= 0.88, "strong").when(m >= 0.72, "related").otherwise("none").alias("alert"))


@query(
    "e12_latest_run_cost",
    "WITH last AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest, max(ts)::DATE AS run_day FROM events GROUP BY 1), passes AS (SELECT e.user_id, latest, run_day, event_type, sum(coalesce(value, 0)) AS usd FROM events e JOIN last l ON e.user_id = l.user_id AND e.ts::DATE = l.run_day GROUP BY ALL) SELECT user_id, latest, run_day, string_agg(event_type, ' ' ORDER BY event_type) AS passes, round(sum(usd), 4) AS total FROM passes GROUP BY 1, 2, 3",
)
def latest_run_cost(g: GraphStore) -> DataFrame:
    """What the passes of each user's latest run cost; a run is a day's events, a pass their type. Older runs don't count."""
    events = g.table("events").filter("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("run_day", F.to_date("ts"))
    per_day = events.groupBy("user_id", "run_day").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("latest"), F.array_sort(F.collect_set("event_type")).alias("types"), F.sum(F.coalesce("value", F.lit(0.0))).alias("usd"))
    last = per_day.groupBy("user_id").agg(F.max_by(F.struct("run_day", "latest", "types", "usd"), "run_day").alias("r"))
    return last.select("user_id", "r.latest", "r.run_day", F.array_join("r.types", " ").alias("passes"), F.round("r.usd", 4).alias("total"))


@query("e24_union_sources", "SELECT source, agent, count(*) AS n FROM (SELECT 'event' AS source, user_id AS agent FROM events UNION ALL SELECT 'turn', conv_id FROM conversations) GROUP BY 1, 2")
def union_sources(g: GraphStore) -> DataFrame:
    a = g.table("events").select(F.lit("event").alias("source"), F.col("user_id").alias("agent"))
    return a.unionByName(g.table("conversations").select(F.lit("turn").alias("source"), F.col("conv_id").alias("agent"))).groupBy("source", "agent").agg(F.count("*").alias("n"))


@query("e26_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct_counts(g: GraphStore) -> DataFrame:
    return g.table("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("g10_pair_precedence", sql("SELECT r.source_id AS a, r.target_id AS b, CASE WHEN x.project_id <> y.project_id THEN 'scope' WHEN x.type = y.type THEN 'block_dup' ELSE 'island' END AS finding FROM revisions r JOIN notes x ON x.id = r.source_id JOIN notes y ON y.id = r.target_id", NOTES))
def pair_precedence(g: GraphStore) -> DataFrame:
    """The first finding that applies to each pair."""
    n = g.notes().select("id", "project_id", "type")
    x, y = n.alias("x"), n.alias("y")
    pairs = g.revisions().select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).join(x, F.expr("x.id = a")).join(y, F.expr("y.id = b"))
    return pairs.select("a", "b", F.when(F.expr("x.project_id <> y.project_id"), "scope").when(F.expr("x.type = y.type"), "block_dup").otherwise("island").alias("finding"))


@query("g14_status_carry", "SELECT o_custkey, (['open', 'in_progress', 'done'])[max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END)::INT] AS status FROM orders GROUP BY 1")
def status_carry(g: GraphStore) -> DataFrame:
    """The most advanced status of a group."""
    rank = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return g.table("orders").groupBy("o_custkey").agg(F.element_at(F.array(F.lit("open"), F.lit("in_progress"), F.lit("done")), F.max(rank)).alias("status"))


@query(
    "g29_task_links",
    sql("SELECT t.id AS task, c.id AS rule FROM live t JOIN live c ON c.project_id = t.project_id AND c.type = 'decision' AND c.priority = 'high' AND c.created_at < t.created_at AND c.created_at >= t.created_at - INTERVAL 30 DAY WHERE t.type = 'task' AND t.work_status = 'open'", NODES),
)
def task_links(g: GraphStore) -> DataFrame:
    """Open tasks and the urgent decisions of the same project in the thirty days before."""
    w = live(g.work())
    day = 86_400_000_000
    made = micros(F.col("created_at"))
    t = w.filter("type = 'task' AND work_status = 'open'").select(F.col("id").alias("task"), "project_id", (made - 30 * day).alias("low"), (made - 1).alias("high"))
    c = w.filter("type = 'decision' AND priority = 'high'").select(F.col("id").alias("rule"), "project_id", made.alias("at"))
    return in_intervals(c, t, "project_id").select("task", "rule")


@query(
    "j08_turns_in_ranges",
    """WITH r AS (SELECT conv_id, turn AS first_turn, turn + 4 AS last_turn FROM conversations WHERE turn % 3 = 0 AND role = 'user')
SELECT r.conv_id, first_turn, last_turn, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(length(text))::BIGINT AS chars, max(turn) AS reached
FROM r JOIN conversations c ON c.conv_id = r.conv_id AND turn BETWEEN first_turn AND last_turn GROUP BY ALL""",
)
def turns_in_ranges(g: GraphStore) -> DataFrame:
    """Extraction ranges (from every third turn that a user took, five turns long, so they overlap) with the turns they cover."""
    c = g.table("conversations")
    ranges = c.filter("turn % 3 = 0 AND role = 'user'").select("conv_id", F.col("turn").alias("first_turn"), (F.col("turn") + 4).alias("last_turn"))
    met = in_intervals(c.select("conv_id", "turn", "role", F.length("text").alias("n")), ranges, "conv_id", "turn", "first_turn", "last_turn")
    return met.groupBy("conv_id", "first_turn", "last_turn").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum("n").cast("bigint").alias("chars"), F.max("turn").alias("reached"))


@query(
    "j08_ledger_in_windows",
    """WITH w AS (SELECT event_id AS window_id, user_id, ts - INTERVAL 30 MINUTE AS low, ts + INTERVAL 30 MINUTE AS high FROM events WHERE event_type = 'error')
SELECT window_id, count(e.event_id) AS entries, round(coalesce(sum(value), 0), 2) AS spent, count(*) FILTER (e.event_type = 'error') AS errors FROM w LEFT JOIN events e ON e.user_id = w.user_id AND ts BETWEEN low AND high GROUP BY 1""",
)
def ledger_in_windows(g: GraphStore) -> DataFrame:
    """What a user's ledger holds half an hour before and after each of their errors."""
    e = g.table("events").withColumn("at", micros(F.col("ts")))
    half = 30 * 60 * 1_000_000
    windows = e.filter("event_type = 'error'").select(F.col("event_id").alias("window_id"), "user_id", (F.col("at") - half).alias("low"), (F.col("at") + half).alias("high"))
    met = in_intervals(e.select("user_id", "at", "value", "event_type"), windows, "user_id")
    return met.groupBy("window_id").agg(F.count("*").alias("entries"), F.round(F.sum("value"), 2).alias("spent"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("g35_prunes", sql("SELECT type, count(*) AS left_over FROM cur WHERE type NOT IN ('affects') GROUP BY 1", EDGES))
def prunes(g: GraphStore) -> DataFrame:
    return current(g.edges()).filter("type <> 'affects'").groupBy("type").agg(F.count("*").alias("left_over"))


@query("h02_resent_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) AS r FROM (SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, role FROM conversations WHERE role = 'user')) WHERE r = 1")
def resent_turns(g: GraphStore) -> DataFrame:
    """Turns once each, though the users' came twice."""
    c = g.table("conversations").select("conv_id", "turn", "role")
    return c.unionByName(c.filter("role = 'user'")).dropDuplicates(["conv_id", "turn"])


@query("h11_canvas", sql("SELECT o.step, n.id FROM (SELECT DISTINCT o_orderpriority AS step FROM orders) o LEFT JOIN (SELECT essence, id FROM live WHERE type = 'decision' AND created_at > TIMESTAMP '2001-06-01') n ON n.essence = o.step", NODES))
def canvas(g: GraphStore) -> DataFrame:
    """Steps with what was decided for each since a start."""
    steps = g.table("orders").select(F.col("o_orderpriority").alias("step")).distinct()
    made = live(g.work()).filter((F.col("type") == "decision") & (F.col("created_at") > at("2001-06-01 00:00:00"))).select(F.col("essence").alias("step"), "id")
    return steps.join(made, "step", "left")


@query(
    "h08_superseding_ranges",
    """WITH t AS (SELECT conv_id, turn, turn % 5 = 3 AND NOT min(turn % 5 = 3) OVER (PARTITION BY conv_id) AS late FROM conversations),
base AS (SELECT conv_id, no AS range_no, min(turn) AS first, max(turn) AS last, count(*) AS turns FROM (SELECT *, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 5)::BIGINT AS no FROM t WHERE NOT late) GROUP BY 1, 2),
l AS (SELECT t.conv_id, t.turn, coalesce((SELECT max(range_no) FROM base b WHERE b.conv_id = t.conv_id AND b.first <= t.turn), 0) AS range_no FROM t WHERE late),
v AS (SELECT *, row_number() OVER w AS version, min(turn) OVER w AS lo, max(turn) OVER w AS hi FROM l WINDOW w AS (PARTITION BY conv_id, range_no ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, range_no, 0::BIGINT AS version, first, last, turns, NULL AS supersedes FROM base
UNION ALL SELECT conv_id, range_no, version, least(first, lo), greatest(last, hi), turns + version, conv_id || ':' || range_no || ':' || (version - 1) FROM v JOIN base USING (conv_id, range_no)""",
)
def superseding_ranges(g: GraphStore) -> DataFrame:
    """Ranges of five turns, every fifth turn being late."""
    return temporal.superseding_ranges(g.table("conversations").withColumn("late", F.col("turn") % 5 == 3))


_BASES = "ties AS (SELECT source_id, target_id, 'supersedes' AS type FROM revisions UNION SELECT 'd' || doc_id, 'd' || (doc_id - 3), 'based_on' FROM documents WHERE doc_id % 4 = 0)"
_NEWER = "newer AS (SELECT r.target_id AS id, CASE n.type WHEN 'dead_end' THEN 'resolved_by' ELSE 'superseded_by' END AS meaning, max_by(s.label, (s.created_at, s.label)) AS by_label FROM revisions r JOIN notes n ON n.id = r.target_id JOIN notes s ON s.id = r.source_id GROUP BY 1, 2)"


@query(
    "b05_block_edges",
    sql(
        "SELECT e.id, side, e.type, other, n.label AS other_label, CASE WHEN length(n.essence) > 140 THEN left(n.essence, 137) || '…' ELSE n.essence END AS gist, meaning, by_label FROM (SELECT source_id AS id, 'out' AS side, type, target_id AS other FROM ties UNION ALL SELECT target_id, 'in', type, source_id FROM ties) e JOIN notes b ON b.id = e.id JOIN notes n ON n.id = e.other LEFT JOIN newer ON newer.id = e.other",
        NOTES,
        ctes=f"{_BASES},\n{_NEWER}",
    ),
)
def block_edges(g: GraphStore) -> DataFrame:
    """All notes with what they are based on and replace, what that claims, and whether it still holds."""
    notes = g.notes()
    bases = g.table("documents").filter("doc_id % 4 = 0").select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.concat(F.lit("d"), F.col("doc_id") - 3).alias("target_id"), F.lit("based_on").alias("type"))
    ties = g.revisions().select("source_id", "target_id", "type").unionByName(bases)
    return R.block_edges(notes.select("id"), notes, ties, S.superseded(notes.drop("essence"), g.revisions()))


@query(
    "b05_block_view",
    sql(
        "SELECT n.id, n.label, n.type, lang, source, n_chars::VARCHAR AS chars, meaning, by_label, coalesce(receipts, 0) AS receipts, first_turn, last_turn FROM notes n JOIN documents d USING (doc_id) LEFT JOIN newer USING (id) LEFT JOIN took USING (id)",
        NOTES,
        ctes=f"""{_NEWER},
spans AS (SELECT conv_id, turn AS first_turn, turn + 4 AS last_turn FROM conversations WHERE turn % 3 = 0 AND role = 'user'),
took AS (SELECT id, count(*) AS receipts, arg_max(first_turn, (first_turn, last_turn)) AS first_turn, arg_max(last_turn, (first_turn, last_turn)) AS last_turn FROM notes JOIN spans ON conv_id = doc_id % 50 AND doc_id % 6 BETWEEN first_turn AND last_turn GROUP BY 1)""",
    ),
)
def block_view(g: GraphStore) -> DataFrame:
    """All notes with their payload, what has replaced them, and the turn ranges they were extracted from."""
    notes = g.notes()
    d = g.table("documents")
    payload = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("chars"), F.col("n_chars").cast("string")).alias("payload"))
    c = g.table("conversations")
    ranges = c.filter("turn % 3 = 0 AND role = 'user'").select("conv_id", F.col("turn").alias("first_turn"), (F.col("turn") + 4).alias("last_turn"))
    took = R.receipts(d.select(F.concat(F.lit("d"), "doc_id").alias("id"), (F.col("doc_id") % 50).alias("conv_id"), (F.col("doc_id") % 6).alias("turn")), ranges, "conv_id")
    view = notes.select("id", "label", "type").join(payload, "id").join(S.superseded(notes.drop("essence"), g.revisions()), "id", "left").join(took, "id", "left")
    return view.select("id", "label", "type", *(F.col("payload")[k].alias(k) for k in ("lang", "source", "chars")), "meaning", "by_label", F.coalesce("receipts", F.lit(0)).alias("receipts"), "first_turn", "last_turn")
