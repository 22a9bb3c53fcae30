"""Slices, neighbourhoods, duplicate alerts, pre-search and conflicts on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells
from ..operators import nearby as N
from ..operators import smart as M
from ..operators import traverse as T
from ..sources.graph import GraphStore, at, current, live, pick
from ..operators.search import STOP
from .prelude import EDGES, NODES, sql
from .search import STEM_SQL
from .traverse import PAIRS

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


_DOT = "list_dot_product({0}.e, {1}.e) / (sqrt(list_dot_product({0}.e, {0}.e)) * sqrt(list_dot_product({1}.e, {1}.e)))"
_VALUE = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[`\"''.]', '', 'g'), '\\s+', ' ', 'g'))"
_IDENTITY = "CASE WHEN {0}.v = {1}.v AND {0}.v <> '' THEN 1.0 WHEN len(list_intersect({0}.w, {1}.w)) > 0 THEN 0.5 * len(list_intersect({0}.w, {1}.w)) / len(list_distinct(list_concat({0}.w, {1}.w))) ELSE 0 END::DOUBLE"


def _valued(table: str, where: str) -> str:
    return f"SELECT *, list_distinct(list_filter(string_split(v, ' '), lambda x: length(x) > 2)) AS w FROM (SELECT *, {_VALUE.format('essence')} AS v FROM {table} WHERE {where})"


def with_vectors(g: GraphStore) -> DataFrame:
    """vec_id, id and v of the parts that have a vector."""
    return g.table("embeddings").select("vec_id", F.concat(F.lit("p"), "vec_id").alias("id"), F.col("embedding").alias("v"))


@query(
    "c18_graph_slices",
    sql(
        f"""SELECT query_id, id, round(identity, 6) AS identity, round(semantic, 5) AS semantic, round(rank, 6) AS rank, scope, catch_all, place FROM (
  SELECT query_id, id, identity, semantic, identity + least(semantic, 1.0) * 0.2::DOUBLE AS rank, string_split(label, '_')[1] AS scope, string_split(label, '_')[1] = 'unspecified-project' AS catch_all,
    row_number() OVER (PARTITION BY query_id ORDER BY round(identity + least(semantic, 1.0) * 0.2::DOUBLE, 9) DESC, id) AS place
  FROM (SELECT q.id AS query_id, n.id, n.label, {_IDENTITY.format('q', 'n')} AS identity, CASE WHEN n.e IS NULL THEN 0 ELSE {_DOT.format('q', 'n')} END AS semantic,
      len(list_filter(q.concepts, lambda c: len(list_filter(n.concepts, lambda d: contains(c, d) OR contains(d, c))) > 0)) > 0 AS kin
    FROM (SELECT * FROM items WHERE vec_id % 50 = 0) q JOIN items n ON q.id <> n.id)
  WHERE (identity > 0 OR kin) AND (identity + least(semantic, 1.0) * 0.2::DOUBLE > 0 OR semantic >= 0.5)) WHERE place <= 20""",
        NODES,
        ctes=f"items AS (SELECT a.*, vec_id, embedding::DOUBLE[] AS e FROM ({_valued('live', chr(39).join(['type = ', 'artifact', '']))}) a LEFT JOIN embeddings ON a.id = 'p' || vec_id)",
    ),
)
def graph_slices(g: GraphStore) -> DataFrame:
    """The twenty best candidates for every part whose vector's id is divisible by 50, by value, words and vector."""
    parts, vectors = live(g.artifacts()), with_vectors(g)
    asked = parts.join(vectors.filter("vec_id % 50 = 0").select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("essence").alias("value"), "concepts")
    found = N.graph_slices(parts, asked, 20, g.roots(), vectors.select("id", "v"))
    return found.select("query_id", "id", F.round("identity", 6).alias("identity"), F.round("semantic", 5).alias("semantic"), F.round("rank", 6).alias("rank"), "scope", "catch_all", "place")


@query(
    "f18_neighbourhood",
    sql(
        "SELECT anchor, id, tier, place FROM surfaced UNION ALL SELECT anchor, id, 'near', place FROM near",
        NODES,
        EDGES,
        ctes=f"""{PAIRS},
rel AS (SELECT root_a AS root, root_b AS other FROM pairs UNION SELECT root_b, root_a FROM pairs UNION SELECT id, id FROM nodes WHERE type = 'project'),
items AS ({_valued('live', "type <> 'project'")}),
anchors AS (SELECT * FROM items WHERE type = 'task' AND substr(id, 2)::BIGINT % 50 = 0 UNION ALL SELECT * FROM items WHERE type = 'artifact' AND substr(id, 2)::BIGINT % 50 = 0
  UNION ALL {_valued('nodes', "type = 'task' AND status = 'archived' AND substr(id, 2)::BIGINT % 50 = 0")}),
members AS (SELECT a.id AS anchor, n.id, row_number() OVER (PARTITION BY a.id ORDER BY n.updated_at DESC, n.id) AS p FROM anchors a JOIN rel ON rel.root = a.project_id JOIN items n ON n.project_id = rel.other AND n.id <> a.id QUALIFY p <= 120),
net AS (SELECT a.id AS anchor, n.id, row_number() OVER (PARTITION BY a.id ORDER BY round({_IDENTITY.format('a', 'n')}, 9) DESC, n.id) AS p FROM anchors a JOIN items n ON n.id <> a.id AND {_IDENTITY.format('a', 'n')} > 0 WHERE a.id NOT IN (SELECT anchor FROM members WHERE p = 120) QUALIFY p <= 5),
surfaced AS (SELECT anchor, id, tier, row_number() OVER (PARTITION BY anchor ORDER BY tier, p, id) AS place FROM (SELECT anchor, id, 'member' AS tier, p FROM members UNION ALL SELECT anchor, id, 'net', p FROM net m WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.anchor = m.anchor AND x.id = m.id)) QUALIFY place <= 120),
vec AS (SELECT 'p' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.id AS anchor, n.id, row_number() OVER (PARTITION BY a.id ORDER BY round({_DOT.format('a', 'n')}, 9) DESC, n.id) AS place FROM vec a JOIN vec n ON a.id <> n.id
  WHERE a.id IN (SELECT id FROM anchors) AND n.id IN (SELECT id FROM items) AND {_DOT.format('a', 'n')} >= 0.5 AND NOT EXISTS (SELECT 1 FROM surfaced s WHERE s.anchor = a.id AND s.id = n.id) QUALIFY place <= 5)""",
    ),
)
def neighbourhood(g: GraphStore) -> DataFrame:
    """What surrounds every task and part whose number is divisible by 50: members of related roots, the net, vectors."""
    nodes = live(g.nodes()).filter("type <> 'project'")
    number = F.substring("id", 2, 20).cast("bigint")
    anchors = g.work().filter("type = 'task'").unionByName(live(g.artifacts())).filter(number % 50 == 0)
    members = g.work().select("id", "type", "project_id").unionByName(g.entities().filter("id LIKE 's%'").select("id", "type", "project_id"))
    pairs = T.root_relatedness(members, current(g.supplies()))[0]
    return N.neighbourhoods(anchors, nodes, g.roots(), pairs, with_vectors(g), cells.indexed(g.table("embeddings")))


ITEM_KINDS = ("decision", "constraint", "dead_end", "blueprint", "fact", "decision", "insight", "blueprint", "dead_end", "question")
_KIND = "([" + ", ".join(f"'{k}'" for k in ITEM_KINDS) + "])[label + 1]"
_ITEMS = f"items AS (SELECT vec_id, {_KIND} AS kind, p_type AS project, lower(p_brand) || '_' || {_KIND} || '_' || replace(p_name, ' ', '-') AS name, p_name || ', ' || p_type AS text, TIMESTAMP '2022-01-01' + to_days((p_partkey % 365)::INT) AS created_at, embedding::DOUBLE[] AS e FROM embeddings JOIN part ON p_partkey = vec_id)"


def items(g: GraphStore) -> DataFrame:
    """Parts with a vector as items: their kind goes by the vector's label, their project is the part's type."""
    v = g.table("embeddings").join(g.table("part"), F.col("p_partkey") == F.col("vec_id"))
    kind = pick(ITEM_KINDS, F.col("label"))
    made = F.lit("2022-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("p_partkey") % 365).cast("int"))
    return v.select("vec_id", F.col("vec_id").alias("id"), F.col("vec_id").alias("item"), "embedding", kind.alias("kind"), F.col("p_type").alias("project"), F.concat_ws("_", F.lower("p_brand"), kind, F.replace("p_name", F.lit(" "), F.lit("-"))).alias("label"), F.concat_ws(", ", "p_name", "p_type").alias("text"), made.alias("created_at"))


@query(
    "d16_alerts_by_kind",
    f"""WITH {_ITEMS} SELECT vec_id, nearest, round(s, 5) AS similarity, CASE WHEN s >= 0.88 THEN 'strong' ELSE 'related' END AS alert FROM (
  SELECT a.vec_id, b.vec_id AS nearest, {_DOT.format('a', 'b')} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT.format('a', 'b')}, 6) DESC, b.vec_id) AS r
  FROM items a JOIN items b ON a.kind = b.kind AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND a.kind IN ('decision', 'constraint', 'dead_end', 'blueprint') AND {_DOT.format('a', 'b')} >= 0.72) WHERE r = 1""",
)
def alerts_by_kind(g: GraphStore) -> DataFrame:
    """The nearest item of the same weighty kind, for all items whose id is divisible by 50."""
    weighty = items(g).filter(F.col("kind").isin(*N.WEIGHTY))
    return N.duplicate_alerts(weighty.filter("vec_id % 50 = 0"), cells.indexed(weighty, group="kind")).withColumn("similarity", F.round("similarity", 5))


@query(
    "d16_presearch",
    f"""WITH {_ITEMS},
always AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY vec_id) AS place FROM items WHERE kind IN ('dead_end', 'constraint')),
q AS (SELECT * FROM items WHERE vec_id % 50 = 0), others AS (SELECT * FROM items WHERE kind NOT IN ('dead_end', 'constraint')),
match AS (SELECT q.vec_id AS item, o.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format('q', 'o')}, 6) DESC, o.vec_id) AS place FROM q JOIN others o ON q.project = o.project AND q.vec_id <> o.vec_id AND {_DOT.format('q', 'o')} >= 0.72 QUALIFY place = 1)
SELECT q.vec_id AS item, a.vec_id AS id, 'anchor' AS why, place FROM q JOIN always a USING (project)
UNION ALL SELECT item, id, 'match', place FROM match
UNION ALL SELECT q.vec_id, o.vec_id, 'recent', row_number() OVER (PARTITION BY q.vec_id ORDER BY o.created_at DESC, o.vec_id) AS p FROM q JOIN others o USING (project) WHERE o.kind = 'decision' AND o.vec_id <> q.vec_id AND NOT EXISTS (SELECT 1 FROM match m WHERE m.item = q.vec_id AND m.id = o.vec_id) QUALIFY p <= 8""",
)
def presearch(g: GraphStore) -> DataFrame:
    """What is shown beside every item whose id is divisible by 50: the anchors of its project, its match, recent decisions."""
    every = items(g)
    return N.presearch(every.filter("vec_id % 50 = 0"), every, cells.indexed(every, group="project"))


#: Words of the tables' texts that say nothing of what an item is about.
DULL = ("small", "large", "cold", "blue")


@query(
    "d16_conflicts",
    f"""WITH {_ITEMS},
q AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 4 AND w NOT IN ('{"', '".join(DULL)}')) AS nouns FROM items WHERE vec_id % 50 = 0 AND kind = 'dead_end'),
old AS (SELECT * FROM items WHERE kind IN ('decision', 'blueprint') AND vec_id % 3 <> 0),
n AS (SELECT vec_id, unnest(nouns) AS noun, generate_subscripts(nouns, 1) AS pos FROM q),
l AS (SELECT n.vec_id AS item, arg_min(old.vec_id, (pos, old.vec_id)) AS id FROM n JOIN old ON contains(name, noun) GROUP BY 1)
SELECT item, id, 'label' AS why FROM l
UNION ALL SELECT item, id, 'semantic' FROM (SELECT q.vec_id AS item, old.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format('q', 'old')}, 6) DESC, old.vec_id) AS r FROM q JOIN old ON {_DOT.format('q', 'old')} > 0.85 WHERE q.vec_id NOT IN (SELECT item FROM l)) WHERE r = 1""",
)
def conflict_candidates(g: GraphStore) -> DataFrame:
    """The decision or blueprint that each dead end whose id is divisible by 50 may replace; every third item is archived."""
    every = items(g)
    old = every.filter(F.col("kind").isin(*N.REPLACEABLE) & (F.col("vec_id") % 3 != 0))
    return N.conflicts(every.filter("vec_id % 50 = 0 AND kind = 'dead_end'"), old, cells.indexed(old), list(DULL))


_STEM = lambda c: f"list_transform([{c}], lambda w: {STEM_SQL})[1]"
_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP))


@query(
    "c13_recall_smart",
    sql(
        "SELECT query_id, id, ticks, semantic, score, why, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticks DESC, id) AS place FROM scored) WHERE place <= 20",
        NODES,
        ctes=f"""
asks AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 100 = 0 THEN 'why was the ' ELSE 'find ' END || p_name || ' for ' || lower(p_type) || CASE WHEN vec_id % 150 = 0 THEN ', urgent' ELSE '' END AS text, vec_id % 97 AS agent, embedding::DOUBLE[] AS e FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 50 = 0),
words AS (SELECT *, {_STEM('word')} AS stem FROM (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\- ]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({_STOPS}))) AS word FROM asks)),
pool AS (SELECT * FROM live WHERE type <> 'project'),
payload AS (SELECT 'p' || p_partkey AS id, unnest(['brand', 'kind', 'size_class']) AS k, unnest([p_brand, p_type, 'size ' || p_size]) AS v FROM part
  UNION ALL SELECT id, unnest(['work_status', 'rank']), unnest([work_status, priority]) FROM pool WHERE id LIKE 'o%'),
fac AS (SELECT DISTINCT id, facet, name, t FROM (
  SELECT id, 'label' AS facet, (i - 2)::VARCHAR AS name, replace(string_split(lower(label), '_')[i], '-', ' ') AS t FROM (SELECT id, label, unnest(generate_series(2, len(string_split(label, '_')))) AS i FROM pool)
  UNION ALL SELECT id, 'essence', '', lower(essence) FROM pool
  UNION ALL SELECT p.id, 'field', k, replace(lower(k), '_', ' ') FROM payload p JOIN pool USING (id)
  UNION ALL SELECT p.id, 'value', k, lower(v) FROM payload p JOIN pool USING (id)
  UNION ALL SELECT id, 'concept', c, regexp_replace(lower(c), '[-_]', ' ', 'g') FROM (SELECT id, unnest(concepts) AS c FROM pool))),
texts AS (SELECT t, {_STEM("regexp_replace(t, '[-_]', '', 'g')")} AS bare FROM (SELECT DISTINCT t FROM fac)),
meets AS (SELECT s.stem, t FROM (SELECT DISTINCT stem FROM words) s JOIN texts ON contains(t, s.stem) OR contains(bare, s.stem)),
hit0 AS (SELECT query_id, id, facet, name, word, words.stem FROM words JOIN meets USING (stem) JOIN fac USING (t)),
hits AS (SELECT * FROM hit0 h WHERE facet <> 'value' OR NOT EXISTS (SELECT 1 FROM hit0 x WHERE x.facet = 'field' AND x.stem = h.stem AND x.id = h.id AND x.name = h.name)),
ticked AS (SELECT query_id, id, count(*) AS n, sum(CASE facet WHEN 'label' THEN 2.0 WHEN 'essence' THEN 1.5 WHEN 'field' THEN 2.5 WHEN 'value' THEN 1.0 ELSE 0.5 END::DOUBLE) AS w,
  concat_ws(' | ', {", ".join(f"CASE WHEN count(*) FILTER (facet = '{f}') > 0 THEN '{f}[' || string_agg(DISTINCT word, ', ' ORDER BY word) FILTER (facet = '{f}') || ']' END" for f in ("label", "essence", "field", "value", "concept"))}) AS why FROM hits GROUP BY 1, 2),
vec AS (SELECT 'p' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.query_id, v.id, {_DOT.format('a', 'v')} AS s FROM asks a, vec v),
touched AS (SELECT a.query_id, ev.ts, project_id, row_number() OVER (PARTITION BY a.query_id ORDER BY ev.ts DESC, project_id) AS r FROM asks a JOIN events ev ON ev.user_id = a.agent AND ev.ts > TIMESTAMP '2024-01-10' - INTERVAL 30 MINUTE AND ev.ts <= TIMESTAMP '2024-01-10' JOIN nodes n ON n.id = 'o' || ev.event_id WHERE project_id IS NOT NULL),
active AS (SELECT query_id, project_id AS project FROM (SELECT query_id, project_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, max(ts) DESC, project_id) AS r FROM touched WHERE r <= 15 GROUP BY 1, 2) WHERE r = 1),
every AS (SELECT coalesce(t.query_id, m.query_id) AS query_id, coalesce(t.id, m.id) AS id, coalesce(n, 0) AS n, coalesce(w, 0) AS w, why FROM ticked t FULL JOIN (SELECT * FROM near WHERE s >= 0.5 AND id IN (SELECT id FROM pool)) m ON t.query_id = m.query_id AND t.id = m.id),
full_ AS (SELECT x.*, coalesce(near.s, 0) AS s, p.type, p.quality, project, coalesce(project = p.project_id AND n > 0, false) AS ctx, text FROM every x JOIN pool p ON p.id = x.id JOIN asks USING (query_id) LEFT JOIN near ON near.query_id = x.query_id AND near.id = x.id LEFT JOIN active ON active.query_id = x.query_id),
scored AS (SELECT query_id, id, n + ctx::INT AS ticks, round(s, 5) AS semantic,
  round((least((w + CASE WHEN ctx THEN 1.5 ELSE 0 END::DOUBLE) / 20, 1.0::DOUBLE) * 0.6::DOUBLE + s * 0.4::DOUBLE) * (0.75::DOUBLE + quality::DOUBLE / 6 * 0.25::DOUBLE) * CASE WHEN type = 'dead_end' AND (contains(text, 'why') OR contains(text, 'not')) THEN 1.5 ELSE 1.0 END::DOUBLE, 6) AS score,
  CASE WHEN n > 0 THEN concat_ws(' | ', why, CASE WHEN ctx THEN 'context[' || project || ']' END) ELSE 'semantic[' || round(s * 100)::INT || '%]' END AS why FROM full_)""",
    ),
)
def recall_smart(g: GraphStore) -> DataFrame:
    """The twenty best nodes for a question about every part whose vector's id is divisible by 50, asked by an agent at a set time."""
    v = g.table("embeddings").filter("vec_id % 50 = 0").join(g.table("part"), F.col("p_partkey") == F.col("vec_id"))
    text = F.concat(F.when(F.col("vec_id") % 100 == 0, "why was the ").otherwise("find "), "p_name", F.lit(" for "), F.lower("p_type"), F.when(F.col("vec_id") % 150 == 0, ", urgent").otherwise(""))
    asks = v.select(F.col("vec_id").alias("query_id"), text.alias("text"), (F.col("vec_id") % 97).alias("agent"), at("2024-01-10 00:00:00").alias("asked_at"), "vec_id", "embedding")
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))
    parts = g.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.map_from_entries(F.array(pair("brand", F.col("p_brand")), pair("kind", F.col("p_type")), pair("size_class", F.concat(F.lit("size "), "p_size")))).alias("payload"))
    work = g.work()
    state = F.map_from_entries(F.array(pair("work_status", F.col("work_status")), pair("rank", F.col("priority"))))
    nodes = live(g.artifacts()).join(parts, "id").unionByName(live(work).withColumn("payload", state)).unionByName(live(g.entities()).withColumn("payload", F.lit(None).cast("map<string,string>")))
    touched = g.table("events").select(F.col("user_id").alias("agent"), F.col("ts").alias("at"), F.concat(F.lit("o"), "event_id").alias("id")).join(work.select("id", F.col("project_id").alias("project")), "id").drop("id")
    return M.recall_smart(nodes, asks, touched, with_vectors(g).select("id", "v"), 20)
