"""Retrieval queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import recency
from ..operators import search as S
from ..sources.graph import GraphStore, live, now
from .prelude import NODES, NOTES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def asked(g: GraphStore) -> DataFrame:
    """The vectors that are searched for: every one whose id is divisible by 50."""
    return g.table("embeddings").filter("vec_id % 50 = 0")


@query(
    "c01_keyword_search",
    sql("SELECT id, access_count, updated_at FROM (SELECT *, lower(label || chr(10) || essence || chr(10) || array_to_string(concepts, chr(10))) AS hay FROM nodes WHERE status IN ('active', 'created')) WHERE contains(hay, 'widget') OR contains(hay, 'urgent') ORDER BY access_count DESC, updated_at DESC, id LIMIT 40", NODES),
)
def keyword_search(g: GraphStore) -> DataFrame:
    return S.keyword_search(g.nodes(), "how about a widget urgent", 40).select("id", "access_count", "updated_at")


@query(
    "c02_concept_search",
    sql("SELECT id, matched FROM (SELECT id, list_sum([CASE WHEN contains(lower(c), t) OR contains(t, lower(c)) THEN 1 ELSE 0 END FOR c IN list_concat(concepts, concepts) FOR t IN ['x']]) AS u, (SELECT count(*) FROM (SELECT unnest(concepts) AS c), (SELECT unnest(['red', 'economy', 'brand#2', 'widgets']) AS t) WHERE contains(lower(c), t) OR contains(t, lower(c))) AS matched FROM live) WHERE matched > 0".replace("list_sum([CASE WHEN contains(lower(c), t) OR contains(t, lower(c)) THEN 1 ELSE 0 END FOR c IN list_concat(concepts, concepts) FOR t IN ['x']]) AS u, ", ""), NODES),
)
def concept_search(g: GraphStore) -> DataFrame:
    return S.concept_hits(live(g.nodes()), ["red", "economy", "brand#2", "widgets"]).select("id", "matched")


SIM = f"sim AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, {COSINE} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"


@query("c03_cosine", f"WITH {SIM} SELECT query_id, vec_id, label, round(s, 5) AS similarity FROM sim")
def cosines(g: GraphStore) -> DataFrame:
    # labels travel with their vectors, since a join would shuffle every pair
    found = S.semantic_search(g.table("embeddings"), asked(g), floor=-2.0, carried=("label",), digits=5)
    return found.select("query_id", F.col("id").alias("vec_id"), "label", "similarity")


TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id)"


@query("c04_semantic_top_k", f"WITH {SIM} SELECT query_id, vec_id, round(s, 5) AS similarity, place FROM (SELECT *, {TOP} AS place FROM sim WHERE s > 0.2) WHERE place <= 15")
def semantic_top_k(g: GraphStore) -> DataFrame:
    return S.semantic_search(g.table("embeddings"), asked(g), 15).select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"), "place")


HYBRID_SQL = f"""
WITH {SIM},
hay AS (SELECT 'p' || p_partkey AS id, p_partkey % 11 AS access_count, TIMESTAMP '2022-01-01' + to_days((p_partkey % 365)::INT) AS updated_at, lower('part_' || p_partkey || chr(10) || p_name) AS text, list_concat(string_split(lower(p_name), ' '), [lower(p_type), lower(p_brand)]) AS concepts FROM part),
sem AS (SELECT query_id, 'p' || vec_id AS id, s FROM (SELECT *, {TOP} AS place FROM sim WHERE s > 0.2) WHERE place <= 100),
kw AS (SELECT id FROM hay WHERE contains(text || chr(10) || array_to_string(concepts, chr(10)), 'red') OR contains(text || chr(10) || array_to_string(concepts, chr(10)), 'widget') ORDER BY access_count DESC, updated_at DESC, id LIMIT 100),
con AS (SELECT * FROM (SELECT id, (SELECT count(*) FROM (SELECT unnest(concepts) AS c), (SELECT unnest(['red', 'widget']) AS t) WHERE contains(c, t) OR contains(t, c)) AS matched FROM hay) WHERE matched > 0),
qs AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0),
parts AS (SELECT query_id, id, s * 0.5 AS part, 'semantic' AS kind FROM sem UNION ALL SELECT query_id, id, 0.3, 'keyword' FROM qs, kw UNION ALL SELECT query_id, id, least(matched * 0.2::DOUBLE, 0.6::DOUBLE) * 0.4::DOUBLE, 'concept' FROM qs, con),
merged AS (SELECT query_id, id, round(sum(part::DOUBLE), 6) AS score, string_agg(DISTINCT kind, '+' ORDER BY kind) AS match_types FROM parts GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, id) AS place FROM merged JOIN hay USING (id) QUALIFY place <= 50)
"""


def hybrid_parts(g: GraphStore, limit: int) -> DataFrame:
    parts = g.artifacts()
    sem = S.semantic_search(g.table("embeddings"), asked(g), 2 * limit).select("query_id", F.concat(F.lit("p"), "id").alias("id"), "similarity")
    # a vector without a part is no hit
    sem = sem.join(parts.select("id"), "id", "left_semi")
    return S.hybrid(asked(g).select(F.col("vec_id").alias("query_id")), sem, S.keyword_hits(parts, ["red", "widget"]).select("id"), S.concept_hits(parts, ["red", "widget"]).select("id", "matched"), parts, limit)


@query("c05_hybrid_search", HYBRID_SQL + "SELECT query_id, id, score, match_types, place FROM best")
def hybrid_search(g: GraphStore) -> DataFrame:
    return hybrid_parts(g, 50)


@query("c06_weak_result", HYBRID_SQL + "SELECT query_id, NOT coalesce(bool_or(contains(match_types, 'semantic') AND contains(match_types, '+')), false) AS weak FROM best GROUP BY 1")
def weak_result(g: GraphStore) -> DataFrame:
    return S.is_weak(hybrid_parts(g, 50))


@query("c07_root_context", sql("SELECT n.id, r.label AS root_label, left(r.essence, 100) AS root_essence FROM live n LEFT JOIN nodes r ON r.id = n.project_id WHERE n.type = 'task'", NODES))
def root_context(g: GraphStore) -> DataFrame:
    roots = g.roots().select(F.col("id").alias("project_id"), F.col("label").alias("root_label"), F.substring("essence", 1, 100).alias("root_essence"))
    return live(g.work()).filter("type = 'task'").select("id", "project_id").join(roots, "project_id", "left").drop("project_id")


@query("c08_currency", sql("SELECT n.id, s.label AS by_label, CASE n.type WHEN 'dead_end' THEN 'resolved_by' ELSE 'superseded_by' END AS meaning FROM revisions r JOIN notes n ON n.id = r.target_id JOIN notes s ON s.id = r.source_id", NOTES))
def currency(g: GraphStore) -> DataFrame:
    return S.superseded(g.notes().drop("essence"), g.revisions())


@query(
    "c10_recall_fast",
    sql(
        """
SELECT id, round(first, 6) AS first, hop, score FROM (
  SELECT id, first, hop, round(raw / (1 + date_diff('second', updated_at, TIMESTAMP '2024-02-01') / 86400.0::DOUBLE * CASE ttl WHEN 'session' THEN 2.0 WHEN '1hr' THEN 1.0 WHEN '24hr' THEN 0.5 WHEN '1week' THEN 0.1 WHEN 'project' THEN 0.01 ELSE 0.001 END::DOUBLE), 6) AS score
  FROM (SELECT s.*, n.*, (first + CASE WHEN first > 0 THEN hop / 2 ELSE hop END) * CASE WHEN n.type = 'insight' THEN 1.3 ELSE 1.0 END::DOUBLE * CASE WHEN first > 0 THEN 0.75::DOUBLE + quality::DOUBLE / 6 * 0.25::DOUBLE ELSE 1.0 END AS raw FROM scored s JOIN pool n USING (id)) WHERE raw >= 0.2 AND quality > 0)
ORDER BY score DESC, id LIMIT 20""",
        NODES,
        ctes="""
pool AS (SELECT * FROM live WHERE type = 'artifact'),
word AS (SELECT id, CASE (contains(lower(label), 'red')::INT + contains(lower(label), 'part_1')::INT) WHEN 0 THEN 1.0 WHEN 1 THEN 1.2 ELSE 1.5 END::DOUBLE AS part FROM pool WHERE contains(lower(label || chr(10) || essence || chr(10) || array_to_string(concepts, chr(10))), 'red') OR contains(lower(label || chr(10) || essence || chr(10) || array_to_string(concepts, chr(10))), 'part_1')),
idea AS (SELECT id, least(m * 0.5, 0.6)::DOUBLE AS part FROM (SELECT id, (SELECT count(*) FROM (SELECT unnest(concepts) AS c), (SELECT unnest(['red', 'part_1']) AS t) WHERE contains(c, t) OR contains(t, c)) AS m FROM pool) WHERE m > 0),
first AS (SELECT id, sum(part) AS first FROM (SELECT * FROM word UNION ALL SELECT * FROM idea) GROUP BY id),
top AS (SELECT id FROM first ORDER BY first DESC, id LIMIT 5),
spread AS (SELECT DISTINCT id, unnest(concepts) AS concept FROM pool),
rare AS (SELECT concept FROM spread GROUP BY concept HAVING count(*) <= (SELECT greatest(5, floor(count(*) * 0.1)) FROM pool)),
lead AS (SELECT DISTINCT concept FROM spread WHERE id IN (SELECT id FROM top) AND concept IN (SELECT concept FROM rare) ORDER BY concept LIMIT 20),
hops AS (SELECT id, least(count(*) * 0.25, 0.75)::DOUBLE AS hop FROM spread WHERE concept IN (SELECT concept FROM lead) GROUP BY id),
scored AS (SELECT coalesce(first.id, hops.id) AS id, coalesce(first, 0.0)::DOUBLE AS first, coalesce(hop, 0.0)::DOUBLE AS hop FROM first FULL JOIN hops ON first.id = hops.id)""",
    ),
)
def recall_fast(g: GraphStore) -> DataFrame:
    return S.recall(live(g.artifacts()), ["red", "part_1"], now()).withColumn("first", F.round("first", 6))


@query("c11_recency", sql("SELECT id, round(1 / (1 + date_diff('second', updated_at, TIMESTAMP '2024-02-01') / 86400.0::DOUBLE * CASE ttl WHEN 'session' THEN 2.0 WHEN '1hr' THEN 1.0 WHEN '24hr' THEN 0.5 WHEN '1week' THEN 0.1 WHEN 'project' THEN 0.01 ELSE 0.001 END::DOUBLE), 6) AS decay FROM live", NODES))
def recencies(g: GraphStore) -> DataFrame:
    return live(g.nodes()).select("id", F.round(recency(F.col("updated_at"), F.col("ttl"), now()), 6).alias("decay"))


STEM_SQL = "CASE WHEN length(w) < 4 THEN w " + " ".join(f"WHEN w LIKE '%{s}' THEN left(w, length(w) - {len(s)})" for s in ("ation", "tion", "sion", "ment", "ness", "ity", "age", "ing", "ed", "er", "ion", "al", "ly")) + " WHEN w LIKE '%s' AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END"


@query("c12_stems", f"SELECT item_id, {STEM_SQL} AS stem, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9_\\-]+')) AS w FROM benchmark) WHERE length(w) > 1 GROUP BY 1, 2")
def stem_counts(g: GraphStore) -> DataFrame:
    return S.stems(g.table("benchmark"), F.col("text"), "item_id")


@query(
    "c13_recall_ticks",
    sql(
        "SELECT id, round(least(sum(n * CASE facet WHEN 'label' THEN 2.0 WHEN 'essence' THEN 1.5 ELSE 2.5 END::DOUBLE) / 20, 1.0) * 0.6::DOUBLE, 6) AS score, string_agg(facet || ':' || n, ' ' ORDER BY facet || ':' || n) AS why FROM (SELECT id, facet, count(DISTINCT token) AS n FROM facets WHERE token IN ('red', 'part', 'economy', 'widget') GROUP BY 1, 2) GROUP BY id",
        NODES,
        ctes="facets AS (SELECT id, 'label' AS facet, unnest(string_split(label, '_')) AS token FROM live WHERE type = 'artifact' UNION ALL SELECT id, 'essence', unnest(string_split(lower(essence), ' ')) FROM live WHERE type = 'artifact' UNION ALL SELECT id, 'concept', unnest(concepts) FROM live WHERE type = 'artifact')",
    ),
)
def recall_ticks(g: GraphStore) -> DataFrame:
    p = live(g.artifacts())
    facet = lambda name, tokens: p.select("id", F.lit(name).alias("facet"), F.explode(tokens).alias("token"))
    facets = facet("label", F.split("label", "_")).unionByName(facet("essence", F.split(F.lower("essence"), " "))).unionByName(facet("concept", F.col("concepts")))
    return S.ticks(facets, {"label": 2.0, "essence": 1.5, "concept": 2.5}, ["red", "part", "economy", "widget"])


@query(
    "c14_recall_chain",
    "SELECT item_id, round((contains(t, 'thth')::INT + contains(t, 'heon')::INT + contains(t, 'anin')::INT) / 3.0, 4) AS score FROM (SELECT item_id, lower(text) AS t FROM benchmark) WHERE contains(t, 'thth') OR contains(t, 'heon') OR contains(t, 'anin') ORDER BY score DESC, item_id LIMIT 4",
)
def recall_chain(g: GraphStore) -> DataFrame:
    hits = S.hit_count(F.lower("text"), ["thth", "heon", "anin"])
    return g.table("benchmark").select("item_id", F.round(hits / F.lit(3.0), 4).alias("score")).filter("score > 0").orderBy(F.desc("score"), "item_id").limit(4)


@query(
    "c16_find_skill",
    sql(
        "SELECT query_id, id, round(score, 6) AS score, concept AND s < 0.75 AS transferable FROM (SELECT query_id, p.id, coalesce(s, 0) AS s, concept, concept::INT * 0.4::DOUBLE + coalesce(s, 0) * 0.45::DOUBLE + kw::INT * 0.15::DOUBLE AS score FROM (SELECT id, len(list_filter(concepts, lambda c: c IN ('red', 'economy'))) > 0 AS concept, contains(lower(essence), 'widget') AS kw FROM live WHERE type = 'artifact') p LEFT JOIN sim ON p.id = 'p' || sim.vec_id) WHERE score > 0.1 OR concept",
        NODES,
        ctes=SIM,
    ),
)
def find_skill(g: GraphStore) -> DataFrame:
    """Parts that fit, for each query vector; parts without a vector fit by concept and word alone, with a null query_id."""
    wanted = F.array(F.lit("red"), F.lit("economy"))
    p = live(g.artifacts()).select("id", F.arrays_overlap("concepts", wanted).alias("concept"), F.contains(F.lower("essence"), F.lit("widget")).alias("kw"))
    v = g.table("embeddings").select("vec_id", "embedding", F.concat(F.lit("p"), "vec_id").alias("id"))
    # what a part's words leave for its cosine to make up, with some slack; scores are filtered by themselves
    least = F.when(F.col("concept"), -2.0).otherwise((0.1 - F.col("kw").cast("int") * 0.15) / 0.45 - 1e-6)
    fit = S.semantic_search(v.join(p.hint("merge"), "id").withColumn("least", least), asked(g), floor="least", carried=("concept", "kw")).select("query_id", F.concat(F.lit("p"), "id").alias("id"), "concept", "kw", F.col("similarity").alias("s"))
    rest = p.join(S.comparable(v, asked(g)).select("id"), "id", "left_anti").select(F.lit(None).cast("bigint").alias("query_id"), "id", "concept", "kw", F.lit(0.0).alias("s"))
    score = F.col("concept").cast("int") * 0.4 + F.col("s") * 0.45 + F.col("kw").cast("int") * 0.15
    return fit.unionByName(rest).withColumn("score", score).filter((F.col("score") > 0.1) | F.col("concept")).select("query_id", "id", F.round("score", 6).alias("score"), (F.col("concept") & (F.col("s") < 0.75)).alias("transferable"))


@query(
    "c17_cold_start_roots",
    sql(
        "SELECT top, covered, entries, id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY n DESC, access_count DESC, id) AS place FROM ent) JOIN (SELECT top, count(DISTINCT t)::BIGINT AS covered, count(DISTINCT id) AS entries FROM (SELECT top, id, unnest(met) AS t FROM ent) GROUP BY top) USING (top) WHERE place <= 3",
        NODES,
        ctes="ent AS (SELECT n.id, r.project_id AS top, met, len(met) AS n, n.access_count FROM (SELECT *, list_filter(['urgent', 'order_12', 'machinery', 'customer#0000000'], lambda t: contains(lower(label), t) OR len(list_filter(concepts, lambda c: contains(c, t))) > 0) AS met FROM live WHERE type <> 'project') n JOIN nodes r ON r.id = n.project_id AND r.type = 'project' WHERE len(met) > 0)",
    ),
)
def cold_start_roots(g: GraphStore) -> DataFrame:
    tops = g.roots().filter("project_id IS NOT NULL").select("id", F.col("project_id").alias("top"))
    return S.roots_by_terms(live(g.nodes()), tops, ["urgent", "order_12", "machinery", "customer#0000000"])


@query(
    "c18_slice_candidates",
    sql(
        "SELECT id, round(CASE WHEN v = 'red widget' THEN 1.0 ELSE 0.5 * len(list_intersect(w, ['red', 'widget'])) / len(list_distinct(list_concat(w, ['red', 'widget']))) END, 6)::DOUBLE AS rank FROM (SELECT id, lower(essence) AS v, list_distinct(list_filter(string_split(lower(essence), ' '), lambda x: length(x) > 2)) AS w FROM live WHERE type = 'artifact') WHERE v = 'red widget' OR len(list_intersect(w, ['red', 'widget'])) > 0 ORDER BY rank DESC, id LIMIT 60",
        NODES,
    ),
)
def slice_candidates(g: GraphStore) -> DataFrame:
    return S.slice_candidates(live(g.artifacts()), "Red  'Widget'.", 60)


@query("c20_auto_tags", r"SELECT item_id, array_to_string(list_slice(list_distinct_ordered, 1, 6), ',') AS tags FROM (SELECT item_id, list_filter(ws, lambda x, i: length(x) > 3 AND list_position(ws, x) = i) AS list_distinct_ordered FROM (SELECT item_id, string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +') AS ws FROM benchmark))")
def auto_tags(g: GraphStore) -> DataFrame:
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " "), " +")
    return g.table("benchmark").select("item_id", F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3)), 1, 6), ",").alias("tags"))


@query("c22_concept_frequency", sql("SELECT concept, count(*) AS df, round(ln((SELECT count(*) FROM live) / count(*)), 6) AS idf FROM (SELECT DISTINCT id, unnest(concepts) AS concept FROM live) GROUP BY 1", NODES))
def concept_frequency(g: GraphStore) -> DataFrame:
    nodes = live(g.nodes())
    n = nodes.agg(F.count("*").alias("total"))
    df = nodes.select(F.explode(F.array_distinct("concepts")).alias("concept")).groupBy("concept").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("concept", "df", F.round(F.ln(F.col("total") / F.col("df")), 6).alias("idf"))


@query("c23_embedding_text", sql("SELECT id, essence || ' ' || array_to_string(concepts, ' ') AS recipe FROM live WHERE type = 'artifact'", NODES))
def embedding_text(g: GraphStore) -> DataFrame:
    return live(g.artifacts()).select("id", F.concat_ws(" ", "essence", F.array_join("concepts", " ")).alias("recipe"))
