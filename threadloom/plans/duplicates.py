"""Duplicate audits, the gap report, attach decisions, the quarantine summary and auto-recall on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit as A
from ..operators import autorecall as R
from ..operators import search as S
from ..operators import twins as T
from ..sources.graph import GraphStore, _edge, at, live, now, pick
from .prelude import EDGES, NODES, NOTES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


KINDS = ("fact", "insight", "decision")


def versions(g: GraphStore) -> DataFrame:
    """supersedes edges: a part from the one before of the same name, type and brand."""
    before = F.lag("p_partkey").over(Window.partitionBy("p_name", "p_type", "p_brand").orderBy("p_partkey"))
    p = g.table("part").withColumn("cause", before).filter("cause IS NOT NULL")
    return _edge(p.select(F.concat(F.lit("p"), "p_partkey").alias("source_id"), F.concat(F.lit("p"), "cause").alias("target_id")), "supersedes", at("2022-01-01 00:00:00"))


def blocks(g: GraphStore) -> DataFrame:
    """Parts as blocks: their type is the scope, name and brand the value."""
    p = g.table("part")
    concepts = F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"), F.lower("p_brand")))
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_type").alias("scope"), pick(KINDS, F.col("p_partkey")).alias("type"), F.concat_ws(" ", "p_name", "p_brand").alias("value"), concepts.alias("concepts"))


_WORDS = "list_sort(list_filter(list_distinct(string_split_regex(lower({}), '[^a-z0-9]+')), lambda w: length(w) >= 4 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.COMMON) + "], w)))"
PARTS = f"""
versions AS (SELECT 'p' || p_partkey AS x, 'p' || cause AS y FROM (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_name, p_type, p_brand ORDER BY p_partkey) AS cause FROM part) WHERE cause IS NOT NULL),
ties AS (SELECT least(x, y) AS i, greatest(x, y) AS j FROM versions),
blocks AS (SELECT *, min(id) OVER (PARTITION BY scope, type, value, cs) AS first, {_WORDS.format('value')} AS ws FROM (SELECT p_partkey AS k, 'p' || p_partkey AS id, p_type AS scope, (['fact', 'insight', 'decision'])[(p_partkey % 3 + 1)::INT] AS type,
  lower(p_name || ' ' || p_brand) AS value, list_sort(list_distinct(list_concat(string_split(lower(p_name), ' '), [lower(p_type), lower(p_brand)]))) AS cs FROM part)),
judged AS (SELECT x.k % 50 = 0 OR y.k % 50 = 0 AS fresh, x.k AS k, y.k AS l, x.type AS t, y.type AS u, x.id AS i, y.id AS j, least(x.first, y.first) AS a, greatest(x.first, y.first) AS b, len(list_intersect(x.ws, y.ws))::BIGINT AS shared,
  CASE WHEN x.value = y.value THEN 'primary_value_exact' WHEN len(list_intersect(x.ws, y.ws)) >= 3 AND x.type = y.type THEN 'primary_value_overlap' END AS signal
  FROM blocks x JOIN blocks y ON x.scope = y.scope AND x.id < y.id WHERE NOT EXISTS (SELECT 1 FROM ties t WHERE t.i = x.id AND t.j = y.id))"""


@query(
    "g06_project_duplicates",
    f"""
WITH {PARTS},
items AS (SELECT *, min(id) OVER (PARTITION BY cs, ws) AS first FROM (SELECT 'p' || p_partkey AS id, list_sort(list_distinct(list_concat(string_split(lower(p_name), ' '), [lower(p_type), lower(p_brand)]))) AS cs, {_WORDS.format('p_name')} AS ws FROM part)),
pairs AS (SELECT least(x.first, y.first) AS a, greatest(x.first, y.first) AS b, len(list_intersect(x.ws, y.ws))::BIGINT AS shared, len(list_intersect(x.cs, y.cs))::DOUBLE / len(list_distinct(list_concat(x.cs, y.cs))) AS s
  FROM items x JOIN items y ON x.id < y.id WHERE NOT EXISTS (SELECT 1 FROM ties t WHERE t.i = x.id AND t.j = y.id))
SELECT a, b, CASE WHEN s >= 0.6 AND shared >= 2 THEN 'concept+essence' WHEN s >= 0.6 THEN 'concept' ELSE 'essence' END AS signal, round(s, 3) AS similarity, shared, count(*) AS links FROM pairs WHERE s >= 0.6 OR shared >= 2 GROUP BY ALL""",
)
def project_duplicates(g: GraphStore) -> DataFrame:
    """Parts alike in concepts or in words of their name."""
    return T.project_duplicates(g.artifacts().select("id", "concepts", "essence"), versions(g))


@query("g08_block_twins", f"WITH {PARTS} SELECT a, b, signal, shared, count(*) AS links FROM judged WHERE signal IS NOT NULL GROUP BY ALL")
def block_twins(g: GraphStore) -> DataFrame:
    return T.block_duplicates(blocks(g), versions(g))


@query(
    "g12_inline_duplicates",
    f"""
WITH {PARTS},
near AS (SELECT x.vec_id AS k, y.vec_id AS l, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id),
close AS (SELECT DISTINCT least('p' || k, 'p' || l) AS i, greatest('p' || k, 'p' || l) AS j, s >= 0.8 AS closer FROM near WHERE s >= 0.78)
SELECT a, b, signal, shared, count(*) AS links FROM judged WHERE signal IS NOT NULL AND fresh GROUP BY ALL
UNION ALL SELECT i, j, 'essence_embedding', shared, 1 FROM judged JOIN close USING (i, j) WHERE signal IS NULL AND (t = u OR closer AND list_sort([t, u]) = ['fact', 'insight'])""",
)
def inline_duplicates(g: GraphStore) -> DataFrame:
    """New are the parts whose key is divisible by 50."""
    new = g.table("part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    vectors = g.table("embeddings")
    near = S.semantic_search(vectors, vectors.filter("vec_id % 50 = 0"), floor=T.SAME_TYPE_COSINE - 1e-9)
    similar = near.select(F.concat(F.lit("p"), "query_id").alias("query_id"), F.concat(F.lit("p"), "id").alias("id"), "similarity")
    return T.inline_duplicates(new, blocks(g), similar, versions(g))


@query(
    "g10_first_findings",
    f"""
WITH {PARTS}, {NODES},
roots AS (SELECT *, min(id) OVER (PARTITION BY ws) AS first FROM (SELECT id, {_WORDS.format('essence')} AS ws FROM nodes WHERE type = 'project')),
found AS (
  SELECT least(x.first, y.first) AS a, greatest(x.first, y.first) AS b, 1 AS rank FROM roots x JOIN roots y ON x.id < y.id AND len(list_intersect(x.ws, y.ws)) >= 2
  UNION ALL SELECT least(x.first, y.first), greatest(x.first, y.first), 2 FROM blocks x JOIN blocks y ON x.value = y.value AND x.scope <> y.scope
  UNION ALL SELECT a, b, 3 FROM judged WHERE signal IS NOT NULL
  UNION ALL SELECT least(x.first, y.first), greatest(x.first, y.first), 4 FROM blocks x JOIN blocks y ON x.id < y.id AND len(list_intersect(x.cs, y.cs)) >= 3 WHERE NOT EXISTS (SELECT 1 FROM ties t WHERE t.i = x.id AND t.j = y.id))
SELECT a, b, (['project_dup', 'scope', 'block_dup', 'island'])[min(rank)] AS finding FROM found GROUP BY 1, 2""",
)
def first_findings(g: GraphStore) -> DataFrame:
    """The audits' findings of each pair in their order of precedence."""
    b, tied = blocks(g), versions(g)
    return T.first_findings({"project_dup": T.project_duplicates(g.roots(), g.containment()), "scope": T.scope_disagreements(b), "block_dup": T.block_duplicates(b, tied), "island": T.block_islands(b, tied)})


@query(
    "e07_quarantine_summary",
    "WITH q AS (SELECT source, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 40 THEN 'too_short' ELSE 'symbols' END AS reason FROM documents WHERE text IS NULL OR length(text) < 40 OR contains(text, '%%%')) SELECT 'total' AS by, NULL AS key, count(*) AS n FROM q UNION ALL SELECT 'reason', reason, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'session', source, count(*) FROM q GROUP BY 2",
)
def quarantine_summary(g: GraphStore) -> DataFrame:
    """Quarantined documents in all, by reason and by session (their source)."""
    text = F.col("text")
    bad = g.table("documents").filter(text.isNull() | (F.length(text) < 40) | F.contains(text, F.lit("%%%")))
    rows = bad.select("source", F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.length(text) < 40, "too_short").otherwise("symbols").alias("reason"))
    counts = rows.groupBy("source", "reason").agg(F.count("*").alias("n"))
    keys = F.array(F.struct(F.lit("reason").alias("by"), F.col("reason").alias("key")), F.struct(F.lit("session").alias("by"), F.col("source").alias("key")))
    each = counts.select("n", F.inline(keys)).groupBy("by", "key").agg(F.sum("n").alias("n"))
    return each.unionByName(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("by"), F.lit(None).cast("string").alias("key"), "n"))


@query(
    "d12_attach_decisions",
    "SELECT 'o' || o_orderkey AS id, CASE WHEN ok THEN 'attach' ELSE 'keep' END AS action, CASE WHEN ok THEN root END AS root FROM (SELECT o_orderkey, lower(n_name) AS root, o_orderstatus = 'F' AND o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND left(o_orderpriority, 1) <> '4' AS ok FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
)
def attach_decisions(g: GraphStore) -> DataFrame:
    """Orders as verdicts on their customer's nation; every fifth names a root that nobody knows, some have no subject."""
    o = g.table("orders").join(g.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(g.table("nation").select("n_nationkey", F.lower("n_name").alias("root")), F.col("c_nationkey") == F.col("n_nationkey"))
    named = F.when(F.col("o_orderkey") % 5 == 0, F.concat("root", F.lit("-activities"))).otherwise(F.col("root"))
    subject = F.when(F.substring("o_orderpriority", 1, 1) == "4", " ").otherwise(F.col("o_orderpriority"))
    verdict = F.when(F.col("o_orderstatus") == "F", "attach").otherwise("new")
    rows = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), verdict.alias("decision"), (F.col("o_custkey") % 3 != 0).alias("same_owner"), named.alias("matched_root"), subject.alias("shared_subject"))
    return T.attachments(rows, g.roots())


@query(
    "d12_resolutions",
    f"WITH {PARTS} SELECT a AS id, b AS twin, CASE WHEN NOT same THEN 'new_entity' WHEN t = 'decision' OR u = 'decision' THEN 'flag_for_review' WHEN t = u THEN 'attach_existing' ELSE 'new_entity' END AS decision, CASE WHEN same AND (t = 'decision' OR u = 'decision') THEN CASE WHEN t = u THEN 'catch_all_scope' ELSE 'owner_unknown' END END AS reason FROM (SELECT DISTINCT a, b, t, u, signal = 'primary_value_exact' AS same FROM (SELECT a, b, CASE WHEN a = first_i THEN t ELSE u END AS t, CASE WHEN a = first_i THEN u ELSE t END AS u, signal FROM (SELECT j.*, x.first AS first_i FROM judged j JOIN blocks x ON x.id = j.i WHERE signal IS NOT NULL)))",
)
def resolutions(g: GraphStore) -> DataFrame:
    """What becomes of each pair of twins; the owner of a decision is unknown, and other types are other scopes."""
    b = blocks(g)
    kind = b.select("id", "type")
    pairs = T.block_duplicates(b, versions(g)).join(kind.select(F.col("id").alias("a"), F.col("type").alias("t")), "a").join(kind.select(F.col("id").alias("b"), F.col("type").alias("u")), "b")
    scope = F.when((F.col("t") == "decision") | (F.col("u") == "decision"), "owner_unknown").when(F.col("t") == F.col("u"), "same").otherwise("different")
    said = T.resolution(F.col("signal") == "primary_value_exact", scope, F.col("t") == F.col("u"))
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("twin"), said.alias("r")).select("id", "twin", "r.decision", "r.reason")


MESSAGE = "Check the Economy parts of Brand and fix widget with ring"
_ASKED = ["economy", "brand", "widget", "ring", MESSAGE.lower()]
_WANTED = ["check", "economy", "parts", "brand", "fix", "widget", "ring"]
_HAY = "lower(label) || chr(10) || lower(coalesce(essence, ''))"


@query(
    "c15_auto_recall",
    sql(
        "SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, score, reasons, shown FROM (SELECT id, score, reasons, 'loaded' AS shown FROM ranked JOIN greedy USING (place) UNION ALL SELECT id, score, reasons, 'hint' FROM (SELECT * FROM ranked WHERE place NOT IN (SELECT place FROM greedy) ORDER BY place LIMIT 15))",
        NODES,
        EDGES,
        ctes=f"""
held AS (SELECT DISTINCT CASE WHEN source_id = 'n3' THEN target_id ELSE source_id END AS id FROM containment WHERE source_id = 'n3' OR target_id = 'n3'),
near AS (SELECT 'p' || y.vec_id AS id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.vec_id = 0),
hits AS (SELECT n.*, ({' + '.join(f"contains({_HAY}, '{t}')::INT" for t in _ASKED)}) * 0.3::DOUBLE AS word, CASE WHEN s > 0.6 THEN s * 0.5::DOUBLE ELSE 0 END::DOUBLE AS near,
  least((SELECT count(*) FROM (SELECT unnest(concepts) AS c), (SELECT unnest({_WANTED}) AS t) WHERE contains(c, t) OR contains(t, c)) * 0.2::DOUBLE, 0.8::DOUBLE) * 0.4::DOUBLE AS idea, h.id IS NOT NULL AS kin, n.id IN (SELECT source_id FROM evidence) AS was
  FROM live n LEFT JOIN near USING (id) LEFT JOIN held h USING (id)),
parts AS (SELECT *, word + near + idea AS base, CASE WHEN id = 'n3' THEN 0.4 WHEN kin THEN 0.24 ELSE 0 END::DOUBLE + CASE WHEN project_id = 'n3' THEN 0.2 ELSE 0 END::DOUBLE AS context FROM hits),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT id, round((CASE WHEN id = 'n3' OR kin THEN base ELSE base * 0.85::DOUBLE END + context + CASE WHEN was THEN 0.15 ELSE 0 END::DOUBLE) * (CASE WHEN quality > 0 THEN quality ELSE 3 END / 6.0::DOUBLE), 6) AS score,
  concat_ws(',', CASE WHEN word > 0 THEN 'keyword' END, CASE WHEN near > 0 THEN 'semantic' END, CASE WHEN idea > 0 THEN 'concept' END, CASE WHEN context > 0 THEN 'context' END) AS reasons,
  length('[' || id || '] ' || label || ' (' || type || ') ' || coalesce(essence, '') || ' / ' || array_to_string(concepts, ', ')) AS chars FROM parts WHERE base + context > 0) WHERE score >= 0.1),
greedy AS (SELECT 0 AS n, 0::BIGINT AS place, 0 AS used UNION ALL SELECT * FROM (SELECT n + 1, r.place, used + r.chars FROM greedy g JOIN ranked r ON r.place > g.place AND g.used + r.chars < 3000 WHERE n < 5 QUALIFY row_number() OVER (ORDER BY r.place) = 1))""",
        recursive=True,
    ),
)
def auto_recall(g: GraphStore) -> DataFrame:
    """What one message recalls in the project n3; the first vector stands for the message's."""
    vectors = g.table("embeddings")
    similar = S.semantic_search(vectors, vectors.filter("vec_id = 0"), floor=R.LEAST_COSINE).select(F.concat(F.lit("p"), "id").alias("id"), "similarity")
    return R.auto_recall(live(g.nodes()), MESSAGE, similar, g.evidence().select(F.col("source_id").alias("id")), g.containment(), "n3")


@query(
    "e25_concept_overlap",
    f"WITH {PARTS}, k AS (SELECT *, min(id) OVER (PARTITION BY cs) AS one FROM blocks) SELECT least(x.one, y.one) AS a, greatest(x.one, y.one) AS b, len(list_intersect(x.cs, y.cs))::BIGINT AS shared, count(*) AS links FROM k x JOIN k y ON x.id < y.id AND len(list_intersect(x.cs, y.cs)) >= 4 GROUP BY ALL",
)
def concept_overlap(g: GraphStore) -> DataFrame:
    """Parts of any name that share four concepts or more."""
    return T.concept_pairs(g.artifacts(), 4)


@query(
    "g04_gap_report",
    sql(
        "SELECT 'orphan' AS gap, id, NULL AS detail FROM all_n WHERE type <> 'project' AND id NOT IN (SELECT id FROM links) UNION ALL SELECT 'task', id, concat_ws(',', CASE WHEN NOT d THEN 'decision' END, CASE WHEN NOT c THEN 'constraint' END) FROM state WHERE type = 'task' AND NOT (d AND c) UNION ALL SELECT 'open_question', id, NULL FROM state WHERE type = 'question' AND NOT a UNION ALL SELECT 'open_conflict', source_id, target_id FROM revisions UNION ALL SELECT 'dead_end', id, NULL FROM all_n WHERE type = 'dead_end' AND id NOT IN (SELECT id FROM links WHERE type = 'contradicts') UNION ALL SELECT 'stale_draft', id, NULL FROM all_n WHERE type = 'draft' AND created_at < TIMESTAMP '2024-01-25' UNION ALL SELECT 'next_question', 'n' || n_nationkey, 'what is open in ' || lower(n_name) FROM nation",
        NODES,
        NOTES,
        EDGES,
        ctes="""
all_n AS (SELECT id, CASE type WHEN 'artifact' THEN 'draft' ELSE type END AS type, work_status, created_at FROM live UNION ALL SELECT id, type, NULL, created_at FROM notes),
links AS (SELECT source_id AS id, target_id AS other, type FROM cur UNION ALL SELECT target_id, source_id, type FROM cur UNION ALL SELECT source_id, target_id, 'supersedes' FROM revisions UNION ALL SELECT target_id, source_id, 'supersedes' FROM revisions),
state AS (SELECT n.id, n.type, coalesce(bool_or(o.type = 'decision'), false) AS d, coalesce(bool_or(o.type = 'constraint'), false) AS c, coalesce(bool_or(o.type IN ('fact', 'decision', 'answer')), false) AS a
  FROM all_n n LEFT JOIN links USING (id) LEFT JOIN all_n o ON o.id = links.other WHERE n.type = 'question' OR n.type = 'task' AND n.work_status <> 'done' GROUP BY 1, 2)""",
    ),
)
def gap_report(g: GraphStore) -> DataFrame:
    """All seven passes over the graph and the notes; parts stand for drafts, revisions for conflicts."""
    nodes = g.nodes().withColumn("type", F.when(F.col("type") == "artifact", "draft").otherwise(F.col("type"))).unionByName(g.notes())
    conflicts = g.revisions().select(F.col("source_id").alias("id"), F.col("target_id").alias("detail"))
    questions = g.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("what is open in "), F.lower("n_name")).alias("detail"))
    return A.gap_report(nodes, g.edges().unionByName(g.revisions()), conflicts, questions, now())
