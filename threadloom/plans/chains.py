"""Recall of reasoned nodes, the terms of a session, and scans by chain and by missing vector, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import items as I
from ..operators.reads import top_in_group
from ..sources.graph import GraphStore, at, live, pick
from .prelude import EDGES, NODES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


def reasoned(g: GraphStore) -> DataFrame:
    """Parts: every third is derived from the two after it, and every second has its type for a problem."""
    k = F.col("p_partkey")
    inputs = F.when(k % 3 == 0, F.array(F.concat(F.lit("p"), k + 1), F.concat(F.lit("p"), k + 2)))
    return g.table("part").select(F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit("part_"), k).alias("label"), F.col("p_name").alias("essence"), F.when(k % 2 == 0, F.col("p_type")).alias("problem"), F.when(k % 3 == 0, F.col("p_brand")).alias("logic"), inputs.alias("inputs"), (1 + k % 5).alias("quality"))


def asked(g: GraphStore) -> DataFrame:
    return g.table("part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name").alias("text"))


_RECALLED = r"""
r AS (SELECT p_partkey AS k, 'p' || p_partkey AS id, p_name AS essence, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS problem, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS logic FROM part),
t AS (SELECT *, lower(concat_ws(' ', essence, problem, logic)) AS string FROM r WHERE k % 3 = 0 OR (problem IS NOT NULL AND 1 + k % 5 >= 3)),
w AS (SELECT p_partkey AS query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda x: length(x) >= 4)) AS term FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT query_id, id, problem, essence, k, count(*) FILTER (contains(string, term)) / count(*) AS score FROM w CROSS JOIN t GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s WHERE score > 0 QUALIFY place <= 4)"""


@query("c14_recalled_chains", sql("SELECT query_id, place, id, score, coalesce(problem, left(essence, 80)) AS problem FROM best", ctes=_RECALLED))
def recalled_chains(g: GraphStore) -> DataFrame:
    """The four best reasoned parts for every fiftieth part's words."""
    return C.recalled_chains(reasoned(g), asked(g), 4)


@query("c14_premises", sql("SELECT query_id, place, step::INT AS step, r.id, 'part_' || r.k AS label, r.essence FROM (SELECT query_id, place, best.k, unnest([0, 1]) AS step FROM best WHERE best.k % 3 = 0) b JOIN r ON r.k = b.k + step + 1", ctes=_RECALLED))
def premises(g: GraphStore) -> DataFrame:
    """What those rest on."""
    return C.premises(C.recalled_chains(reasoned(g), asked(g), 4), reasoned(g))


@query(
    "h10_session_terms",
    r"""WITH log AS (SELECT TIMESTAMP '2024-01-01' + to_minutes(conv_id * 9 + turn) AS made, text FROM conversations WHERE role = 'user'), prev AS (SELECT * FROM log WHERE made < TIMESTAMP '2024-01-01 05:00:00'),
words AS (SELECT made, lower(regexp_replace(unnest(string_split_regex(text, '\s+')), '[^A-Za-z0-9_]', '', 'g')) AS term FROM prev), asked AS (SELECT term, min(made) AS asked FROM words WHERE length(term) > 4 AND term NOT IN ('about', 'should') GROUP BY 1),
saved AS (SELECT doc_id, lower(text) AS t, 'doc_' || doc_id AS label, lower(lang) AS lang FROM documents WHERE TIMESTAMP '2024-01-01' + to_minutes(doc_id) BETWEEN (SELECT min(made) FROM prev) AND (SELECT max(made) FROM prev) + INTERVAL 60 SECOND)
SELECT term, asked, EXISTS (SELECT 1 FROM saved WHERE contains(t, term) OR contains(label, term) OR contains(lang, term)) AS covered FROM asked""",
)
def session_terms(g: GraphStore) -> DataFrame:
    """What users asked before a restart, and whether a document of that time has it."""
    minute = (F.col("conv_id") * 9 + F.col("turn")).cast("int")
    log = g.table("conversations").filter("role = 'user'").select((at("2024-01-01 00:00:00") + F.make_dt_interval(mins=minute)).alias("at"), "text")
    return C.session_terms(log, g.notes(), at("2024-01-01 05:00:00"), ["about", "should"])


@query("a06_by_chain", sql("SELECT n.id, e.target_id AS chain, n.created_at, row_number() OVER (PARTITION BY e.target_id ORDER BY n.created_at, n.id) AS place FROM live n JOIN cur e ON e.source_id = n.id AND e.type = 'part_of' WHERE n.id LIKE 'o%' QUALIFY place <= 20", NODES, EDGES))
def by_chain(g: GraphStore) -> DataFrame:
    """The first twenty nodes of each chain in the order of their making, a customer's orders being one."""
    part_of = g.containment().filter("source_id LIKE 'o%'").select(F.col("source_id").alias("id"), F.col("target_id").alias("chain"))
    return top_in_group(live(g.work()).select("id", "created_at").join(part_of, "id"), ["chain"], [F.col("created_at"), F.col("id")], 20)


@query("a06_missing_vectors", sql("SELECT id, updated_at FROM live WHERE type = 'artifact' AND id NOT IN (SELECT 'p' || vec_id FROM embeddings WHERE embedding IS NOT NULL)", NODES))
def missing_vectors(g: GraphStore) -> DataFrame:
    """Live parts that no vector belongs to."""
    have = g.table("embeddings").filter("embedding IS NOT NULL").select(F.concat(F.lit("p"), "vec_id").alias("id"))
    return live(g.artifacts()).select("id", "updated_at").join(have, "id", "left_anti")


def passes(g: GraphStore) -> tuple[DataFrame, DataFrame]:
    """An order is an arc, its lines are items: their types before and after a second look."""
    li = g.table("lineitem").groupBy(F.col("l_orderkey").alias("arc"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_linenumber").alias("place")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    p, s = F.col("part"), F.col("supp")
    first = li.filter(s % 11 != 0).select("arc", "id", pick(("fact", "task", "decision"), p).alias("type"), F.when(p % 5 == 0, F.concat_ws("-", "arc", F.lit(1))).alias("extends"))
    second = li.select("arc", "id", "place", pick(("fact", "task", "decision"), F.when(s % 4 == 0, s).otherwise(p)).alias("type"), F.when(p % 2 == 0, "").when(p % 3 == 0, "x").alias("extends"), F.when(s % 7 == 0, "weak_match").when(s % 7 == 1, "").alias("review_reason"))
    return first, second


_PASSES = """
li AS (SELECT l_orderkey AS arc, l_orderkey || '-' || l_linenumber AS id, l_linenumber AS place, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
a AS (SELECT arc, id, (['fact', 'task', 'decision'])[(p % 3 + 1)::INT] AS type, CASE WHEN p % 5 = 0 THEN arc || '-1' END AS extends FROM li WHERE s % 11 <> 0),
b AS (SELECT arc, id, place, (['fact', 'task', 'decision'])[(CASE WHEN s % 4 = 0 THEN s ELSE p END % 3 + 1)::INT] AS type, CASE WHEN p % 2 = 0 THEN '' WHEN p % 3 = 0 THEN 'x' END AS extends, CASE s % 7 WHEN 0 THEN 'weak_match' WHEN 1 THEN '' END AS review_reason FROM li),
blocks AS (SELECT arc, place AS n, type AS is_a, CASE WHEN place % 3 = 0 THEN id || '?' ELSE arc || '-' || (place + place % 2) END AS from_item FROM b)"""


@query("d07_prefilled", sql("SELECT b.id, b.type, coalesce(nullif(b.extends, ''), a.extends, b.extends) AS extends, CASE WHEN a.type <> b.type AND coalesce(review_reason, '') = '' THEN 'type_override' ELSE review_reason END AS review_reason FROM b LEFT JOIN a USING (id)", ctes=_PASSES))
def prefilled(g: GraphStore) -> DataFrame:
    """Items of the second pass, their extension filled and changes of type stamped."""
    first, second = passes(g)
    return I.prefilled(first, second).select("id", "type", "extends", "review_reason")


@query(
    "d07_recovered",
    sql(
        """SELECT x.arc, x.n, x.is_a, coalesce(f.id, x.from_item) AS from_item, f.id IS NOT NULL AS drifted FROM (SELECT *, CASE WHEN NOT known THEN row_number() OVER (PARTITION BY arc, is_a, known ORDER BY n) END AS k FROM (SELECT *, from_item IN (SELECT id FROM b) AS known FROM blocks)) x
LEFT JOIN (SELECT arc, id, type, row_number() OVER (PARTITION BY arc, type ORDER BY place) AS k FROM b WHERE id NOT IN (SELECT from_item FROM blocks)) f ON f.arc = x.arc AND f.type = x.is_a AND f.k = x.k""",
        ctes=_PASSES,
    ),
)
def recovered(g: GraphStore) -> DataFrame:
    """Blocks built from the items, a third of which name none that exists."""
    second = passes(g)[1]
    n = F.col("place")
    blocks = second.select("arc", n.alias("n"), F.col("type").alias("is_a"), F.when(n % 3 == 0, F.concat("id", F.lit("?"))).otherwise(F.concat_ws("-", "arc", n + n % 2)).alias("from_item"))
    return I.recovered(blocks, second.select("arc", "id", "type", "place"))
