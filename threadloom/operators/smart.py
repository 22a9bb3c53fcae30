"""Recall by ticks: what parts of a node a query's words meet, weighed, with the cosine, quality and an explanation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stem
from ..sources.checkpoints import settled
from ..sources.shipping import shipped
from .cells import matrix
from .grams import contained
from .intervals import micros
from .reads import top_in_group
from .search import STOP

#: What a tick of a facet weighs, how explanations call it, and the words that ask for what went wrong.
WEIGHTS = {"label": 2.0, "essence": 1.5, "field": 2.5, "value": 1.0, "concept": 0.5, "context": 1.5}
WRONG = ("why", "rejected", "failed", "abandoned", "not", "avoid", "revert", "dropped", "gave up")
STRUCTURE, MEANING, ALONE, FULL = 0.6, 0.4, 0.5, 20
WINDOW_MINUTES, LATEST = 30, 15
#: Queries and nodes of a block; a task holds one of each and a few matrices of their size.
ASKED, THERE = 512, 4096


def words_of(queries: DataFrame) -> DataFrame:
    """query_id, word and stem of each query's words of two letters or more that are not stop words, once each."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9_\- ]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*sorted(STOP))))
    return queries.select("query_id", F.explode(words).alias("word")).withColumn("stem", stem(F.col("word")))


def facets(nodes: DataFrame) -> DataFrame:
    """facet, name and text of all that words may meet, beside id, type, project_id and quality: label parts after the first, essence, payload keys and values, concepts.

    nodes: these, label, essence, payload (a map or null), concepts.
    """
    spaced = lambda c: F.regexp_replace(F.lower(c), "[-_]", " ")
    row = lambda facet, name, text: F.struct(F.lit(facet).alias("facet"), name.alias("name"), text.alias("text"))
    label = F.transform(F.slice(F.split(F.lower("label"), "_"), 2, 1000), lambda s, k: row("label", k.cast("string"), F.replace(s, F.lit("-"), F.lit(" "))))
    fields = F.transform(F.map_entries("payload"), lambda e: row("field", e["key"], F.replace(F.lower(e["key"]), F.lit("_"), F.lit(" "))))
    values = F.transform(F.map_entries("payload"), lambda e: row("value", e["key"], F.lower(e["value"])))
    concepts = F.transform("concepts", lambda c: row("concept", c, spaced(c)))
    essence = F.array(row("essence", F.lit(""), F.lower("essence")))
    none = F.array().cast("array<struct<facet:string,name:string,text:string>>")
    every = F.concat(*(F.coalesce(x, none) for x in (label, essence, fields, values, concepts)))
    return nodes.select("id", "type", "project_id", "quality", F.explode(F.array_distinct(every)).alias("f")).select("id", "type", "project_id", "quality", "f.*").filter("text IS NOT NULL")


def profiled(nodes: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stems (stem) nodes contain, as they are or stemmed themselves: nodes (id, type, project_id, quality, kind) and kinds (kind, met). Stored.

    met has a stem and facet for each part that contains the stem, a value only where its key doesn't; nodes of the same met
    are of one kind, those of an empty one are left out. A text that many nodes have is looked up once.
    """
    texts = facets(nodes).select("text").distinct().withColumn("bare", stem(F.regexp_replace("text", "[-_]", "")))
    texts = settled(texts)
    strings = texts.select(F.col("text").alias("string")).unionByName(texts.select(F.col("bare").alias("string")))
    pairs = settled(contained(stems, strings, "stem").withColumnRenamed("needle", "stem"))
    meets = texts.join(pairs.withColumnRenamed("string", "text"), "text").select("text", "stem").unionByName(texts.join(pairs.withColumnRenamed("string", "bare"), "bare").select("text", "stem"))
    meets = settled(meets.groupBy("text").agg(F.collect_set("stem").alias("stems")))
    hits = facets(nodes).join(meets, "text").select("id", "type", "project_id", "quality", "facet", "name", F.explode("stems").alias("stem"))
    met = hits.groupBy("id", "type", "project_id", "quality").agg(F.collect_set(F.struct("stem", "facet", "name")).alias("met"))
    by_key = lambda x: F.exists("met", lambda y: (y["facet"] == "field") & (y["stem"] == x["stem"]) & (y["name"] == x["name"]))
    kept = F.filter("met", lambda x: (x["facet"] != "value") | ~by_key(x))
    met = settled(met.withColumn("met", F.array_sort(F.transform(kept, lambda x: F.struct(x["stem"].alias("stem"), x["facet"].alias("facet"))))))
    kinds = settled(met.select("met").distinct().withColumn("kind", F.monotonically_increasing_id()))
    return settled(met.join(kinds, "met").select("id", "type", "project_id", "quality", "kind")), kinds


def active_projects(queries: DataFrame, accesses: DataFrame) -> DataFrame:
    """query_id and project: of the fifteen nodes an agent touched last, in the half hour up to the query, the commonest project.

    queries: query_id, agent, asked_at; accesses: agent, at, project. Of equals the one touched last, then the smaller name.
    """
    before = F.col("asked_at") - F.expr(f"INTERVAL {WINDOW_MINUTES} MINUTES")
    # an agent that asks several things at one time has one answer
    near = queries.select("agent", "asked_at").distinct().join(accesses.filter("project IS NOT NULL"), "agent").filter((F.col("at") > before) & (F.col("at") <= F.col("asked_at")))
    last = top_in_group(near.select("agent", "asked_at", "at", "project"), ["agent", "asked_at"], [F.desc("at"), F.col("project")], LATEST)
    counts = last.groupBy("agent", "asked_at", "project").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    active = counts.groupBy("agent", "asked_at").agg(F.min_by("project", F.struct((-F.col("n")).alias("n"), (-micros(F.col("at"))).alias("at"), "project")).alias("project"))
    return queries.select("query_id", "agent", "asked_at").join(active, ["agent", "asked_at"]).select("query_id", "project")


def explained(found: Column) -> Column:
    """label[a, b] | concept[c]: the words each facet met, facets in the order of WEIGHTS."""

    def part(facet: str) -> Column:
        words = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["facet"] == facet), lambda x: x["word"])))
        return F.when(F.size(words) > 0, F.concat(F.lit(f"{facet}["), F.array_join(words, ", "), F.lit("]")))

    return F.concat_ws(" | ", *map(part, WEIGHTS))


def blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows (id and others) in blocks of about size: one row a block, its rows in rows."""
    n = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(*df.columns)).alias("rows")).select("rows")


def cosines(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """The cosine of each two vectors; 0 where one is null, zero, not finite or of another length."""
    cos = np.zeros((len(a), len(b)))
    for length in np.unique(np.diff(a.offsets.to_numpy())):
        (mine, asked), (theirs, there) = matrix(a, length), matrix(b, length)
        cos[np.ix_(mine, theirs)] = asked @ there.T
    return cos


def counted(rows: pa.ListArray, stems: pa.Array, names: pa.Array, weights: np.ndarray | None = None) -> np.ndarray:
    """How often, or with what weights, each of names is among the stems of each row."""
    code = pc.index_in(stems, value_set=names)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
    out = np.zeros((len(rows), len(names)))
    np.add.at(out, (row[known], code.drop_null().to_numpy()), 1.0 if weights is None else weights[known])
    return out


def with_vectors_scored(asking: DataFrame, there: DataFrame, limit: int) -> DataFrame:
    """The best nodes that have a vector for each query: query_id, id, kind, met_words, context, semantic and score, limit at most of two blocks.

    asking: id, v, stems (one a word), wrong, project. there: id, v, met, kind, dead, project, quality. Every query meets every
    node, block by block; ticks and their weights are products of matrices as cosines are, so no pair is a row.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                a, b = batch.column(0)[at].values, batch.column(1)[at].values
                mine, met = a.field("stems"), b.field("met")
                words, hits = mine.flatten(), met.flatten()
                names, facets_met = words.unique(), hits.field("facet")
                weights = np.array([WEIGHTS[f] for f in facets_met.unique().to_pylist()])[pc.index_in(facets_met, value_set=facets_met.unique()).to_numpy()] if len(hits) else np.zeros(0)
                asked = counted(mine, words, names)
                ticks, weight = asked @ counted(met, hits.field("stem"), names).T, asked @ counted(met, hits.field("stem"), names, weights).T
                cos = cosines(a.field("v"), b.field("v"))
                projects = pa.concat_arrays([a.field("project"), b.field("project")]).dictionary_encode().indices.fill_null(-1).to_numpy()
                here, of = projects[: len(a), None], projects[None, len(a) :]
                context = (here == of) & (here >= 0) & (ticks > 0)
                quality = b.field("quality").to_numpy(zero_copy_only=False)
                both = a.field("wrong").to_numpy(zero_copy_only=False)[:, None] & b.field("dead").to_numpy(zero_copy_only=False)[None]
                score = (np.minimum((weight + WEIGHTS["context"] * context) / FULL, 1.0) * STRUCTURE + cos * MEANING) * (0.75 + quality / 6 * 0.25) * np.where(both, 1.5, 1.0)
                place = np.where((ticks > 0) | (cos >= ALONE), np.round(score, 6), -np.inf)
                last = np.partition(place, -limit, axis=1)[:, -limit] if place.shape[1] > limit else np.full(len(a), -np.inf)
                q, j = np.nonzero((place >= last[:, None]) & (place > -np.inf))
                ids = b.field("id")
                names_of = np.array(ids.to_pylist(), object)
                # of equal scores the most ticks, then the smallest id
                order = np.lexsort((names_of[j].astype(str), -(ticks + context)[q, j], -place[q, j], q))
                q, j = q[order], j[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < limit
                q, j = q[keep], j[keep]
                columns = [a.field("id").take(pa.array(q)), ids.take(pa.array(j)), b.field("kind").take(pa.array(j)), pa.array(ticks[q, j].astype(np.int64)), pa.array(context[q, j]), pa.array(cos[q, j]), pa.array(score[q, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "kind", "met_words", "context", "semantic", "score"])

    shipped(there.sparkSession)
    one, two = blocks(asking, ASKED).withColumnRenamed("rows", "asked"), settled(blocks(there, THERE))
    return one.crossJoin(two).mapInArrow(meet, "query_id bigint, id string, kind bigint, met_words bigint, context boolean, semantic double, score double")


def recall_smart(nodes: DataFrame, queries: DataFrame, accesses: DataFrame, vectors: DataFrame, limit: int = 5) -> DataFrame:
    """The best nodes for each query: query_id, id, ticks, semantic, score, why and place.

    nodes: id, label, type, essence, payload, concepts, project_id, quality. queries: query_id (a number), text, agent, asked_at and embedding
    (null: none). vectors: id, v. A tick is a word that a part of a node meets; a node of the active project that has one has
    one more. Nodes without ticks come in from a cosine of ALONE on. Dead ends count half more where the query asks for what
    went wrong. Equal scores go by ticks, then id.

    Nodes without a vector that words meet alike score alike: these are ranked as classes, of each of which limit nodes are
    kept, and queries of the same words are asked once. Nodes with a vector meet queries in blocks.
    """
    words = settled(words_of(queries))
    marked, kinds = profiled(nodes, words.select("stem").distinct())
    sets = words.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("word", "stem"))).alias("words"))
    none = F.array().cast("array<struct<word:string,stem:string>>")
    wrong = F.exists(F.array(*map(F.lit, WRONG)), lambda w: F.contains(F.lower("text"), w))
    asking = queries.select("query_id", "agent", "asked_at", "text", "embedding").join(sets, "query_id", "left").join(active_projects(queries, accesses), "query_id", "left")
    asking = settled(asking.select("query_id", "embedding", F.coalesce("words", none).alias("words"), F.coalesce(wrong, F.lit(False)).alias("wrong"), "project"))
    texts = settled(asking.select("words").distinct().withColumn("wording", F.monotonically_increasing_id()))
    weight = F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p))
    met = kinds.select("kind", F.explode("met").alias("m")).select("kind", "m.*")
    hits = texts.select("wording", F.explode("words").alias("w")).select("wording", "w.*").join(met, "stem")
    hits = settled(hits.groupBy("wording", "kind").agg(F.count("*").alias("met_words"), F.sum(weight[F.col("facet")]).alias("weight"), F.collect_set(F.struct("facet", "word")).alias("met")))
    grade = F.when(F.col("quality") > 0, F.col("quality")).otherwise(3)

    # nodes without a vector: classes of equal scores, the best of which are taken apart
    same = ["kind", "dead", "grade", "of"]
    plain = marked.join(vectors.filter("v IS NOT NULL").select("id"), "id", "left_anti").select("id", "kind", (F.col("type") == "dead_end").alias("dead"), grade.alias("grade"), F.col("project_id").alias("of"))
    first = settled(top_in_group(plain, same, [F.col("id")], limit).drop("place"))
    alike = asking.join(texts, "words").select("wording", "wrong", "project").distinct()
    context = F.coalesce(F.col("project") == F.col("of"), F.lit(False))
    structure = F.least((F.col("weight") + F.when(F.col("context"), WEIGHTS["context"]).otherwise(0.0)) / FULL, F.lit(1.0))
    score = structure * STRUCTURE * (0.75 + F.col("grade") / 6 * 0.25) * F.when(F.col("dead") & F.col("wrong"), 1.5).otherwise(1.0)
    classes = alike.join(hits.drop("met"), "wording").join(first.select(same).distinct(), "kind").withColumn("context", context).withColumn("score", F.round(score, 6)).withColumn("ticks", F.col("met_words") + F.col("context").cast("int"))
    ahead = F.rank().over(Window.partitionBy("wording", "wrong", "project").orderBy(F.desc("score"), F.desc("ticks")))
    classes = classes.withColumn("ahead", ahead).filter(F.col("ahead") <= limit)
    matches = [F.col(f"c.{c}").eqNullSafe(F.col(f"n.{c}")) for c in same]
    best = classes.alias("c").join(first.alias("n"), matches).select("c.*", "n.id")
    best = settled(top_in_group(best, ["wording", "wrong", "project"], [F.desc("score"), F.desc("ticks"), F.col("id")], limit).select("wording", "wrong", "project", "id", "kind", "met_words", "context", "score"))
    told = asking.join(texts, "words").select("query_id", F.col("wording").alias("w"), F.col("wrong").alias("x"), F.col("project").alias("p"))
    plain = told.join(best, (F.col("w") == F.col("wording")) & (F.col("x") == F.col("wrong")) & F.col("p").eqNullSafe(F.col("project"))).select("query_id", "id", "kind", "met_words", "context", F.lit(0.0).alias("semantic"), "score")

    # vectors are many times what their columns' sizes make Spark expect, so they are never broadcast
    with_vector = nodes.select("id", "type", "project_id", grade.cast("double").alias("quality")).hint("merge").join(vectors.filter("v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v")), "id")
    with_vector = with_vector.join(marked.select("id", "kind"), "id", "left").join(kinds, "kind", "left")
    nothing = F.array().cast("array<struct<stem:string,facet:string>>")
    there = settled(with_vector.select("id", "v", F.coalesce("met", nothing).alias("met"), "kind", (F.col("type") == "dead_end").alias("dead"), F.col("project_id").alias("project"), "quality"))
    asked = asking.select(F.col("query_id").cast("bigint").alias("id"), F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("v"), F.transform("words", lambda w: w["stem"]).alias("stems"), "wrong", "project")
    found = plain.unionByName(with_vectors_scored(asked, there, limit)).withColumns({"score": F.round("score", 6), "ticks": F.col("met_words") + F.col("context").cast("int")})
    found = settled(top_in_group(found, ["query_id"], [F.desc("score"), F.desc("ticks"), F.col("id")], limit))
    shown = found.join(asking.join(texts, "words").select("query_id", "wording", "project"), "query_id").join(hits.select("wording", "kind", "met"), ["wording", "kind"], "left")
    context_row = F.array(F.struct(F.lit("context").alias("facet"), F.col("project").alias("word")))
    why = F.when(F.col("ticks") > 0, explained(F.when(F.col("context"), F.concat("met", context_row)).otherwise(F.col("met")))).otherwise(F.concat(F.lit("semantic["), F.round(F.col("semantic") * 100).cast("int"), F.lit("%]")))
    return shown.select("query_id", "id", "ticks", F.round("semantic", 5).alias("semantic"), "score", why.alias("why"), "place")
