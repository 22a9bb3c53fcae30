"""Keyword, concept, vector and hybrid retrieval with explained scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import dot, recency
from ..functions.text import jaccard, primary, stem
from ..sources.checkpoints import settled
from ..sources.shipping import shipped
from .cells import matrix, rounded

#: Words of a query that find nothing by themselves.
STOP = frozenset("a about all an and any are but can did does for from had has have how into its not our out that the their them they this use was were what when where which who why will with would you your".split())

SEMANTIC_FLOOR = 0.2
#: Rows of a block of vectors; a task holds two blocks and their cosines.
BLOCK = 1024
WEIGHTS = {"semantic": 0.5, "keyword": 0.3, "concept": 0.4}


def query_terms(text: str, least: int = 3) -> list[str]:
    """Words of a query that are looked for, once each, in order."""
    return list(dict.fromkeys(w for w in text.lower().split() if len(w) >= least and w not in STOP))


def hit_count(haystack: Column, terms: Sequence[str]) -> Column:
    """How many of the terms the text contains."""
    return sum((F.contains(haystack, F.lit(t)).cast("int") for t in terms), F.lit(0))


def keyword_hits(nodes: DataFrame, terms: Sequence[str], columns: Sequence[str] = ("label", "essence")) -> DataFrame:
    """Active or new nodes of which a column contains a term; no terms, no hits."""
    text = F.lower(F.concat_ws("\n", *columns, F.array_join("concepts", "\n")))
    found = nodes.filter(F.col("status").isin("active", "created")).withColumn("hits", hit_count(text, terms).cast("bigint"))
    return found.filter("hits > 0")


def keyword_search(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    return keyword_hits(nodes, query_terms(text)).orderBy(F.desc("access_count"), F.desc("updated_at"), "id").limit(limit)


def concept_hits(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Number of (term, concept) pairs of each node of which one contains the other."""
    wanted = F.array(*(F.lit(t) for t in terms)).cast("array<string>")
    lowered = F.transform("concepts", lambda c: F.lower(c))
    pairs = F.aggregate(lowered, F.lit(0), lambda n, c: n + F.size(F.filter(wanted, lambda t: F.contains(c, t) | F.contains(t, c))))
    return nodes.withColumn("matched", pairs.cast("bigint")).filter("matched > 0")


def _blocks(df: DataFrame, key: str, vector: str, size: int, carried: Sequence[str] = ()) -> DataFrame:
    """Rows in blocks of about size: one row a block, with its ids, vectors and carried columns."""
    n = max(1, -(-df.count() // size))
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), *carried)
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v", *carried)).alias("rows")).select("rows")


def semantic_search(vectors: DataFrame, queries: DataFrame, limit: int | None = None, floor: float | str = SEMANTIC_FLOOR, key: str = "vec_id", vector: str = "embedding", carried: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """query_id, id, similarity and place of the rows with a cosine above floor, for each query; with limit, the nearest.

    queries and vectors: key, vector. Both come in blocks of BLOCK; each two blocks meet once and give limit rows a query
    at most. Equal similarities go by id. Null vectors match nothing, and neither do vectors of another length or of zeros.
    floor may be a column of vectors, one for each row; carried are columns of vectors that come with each pair, so that pairs needn't be joined.
    With digits similarities come rounded, after they were compared and put in order; Spark's expression takes as long as all the rest for all pairs.
    """
    kept = [*carried, *([floor] if isinstance(floor, str) and floor not in carried else [])]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                a, b = (batch.column(c)[at].values for c in (0, 1))
                for length in np.unique(np.diff(a.field("v").offsets.to_numpy())):
                    (mine, asked), (theirs, there) = matrix(a.field("v"), length), matrix(b.field("v"), length)
                    ids, others = a.field("id").to_numpy()[mine], b.field("id").to_numpy()[theirs]
                    cos = asked @ there.T
                    q, j = np.nonzero(cos > (b.field(floor).to_numpy()[theirs] if isinstance(floor, str) else floor))
                    if limit:
                        order = np.lexsort((others[j], -cos[q, j], q))
                        q, j = q[order], j[order]
                        keep = np.arange(len(q)) - np.searchsorted(q, q) < limit
                        q, j = q[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(others[j]), pa.array(cos[q, j] if digits is None else rounded(cos[q, j], digits) / 10.0**digits), *(b.field(c).take(pa.array(theirs[j])) for c in carried)], names=["query_id", "id", "similarity", *carried])

    shipped(vectors.sparkSession)
    # stored, since the other side would else build the vectors' blocks again in each of its partitions
    asked, there = _blocks(queries, key, vector, BLOCK).withColumnRenamed("rows", "asked"), settled(_blocks(vectors, key, vector, BLOCK, kept))
    found = asked.crossJoin(there).mapInArrow(meet, ", ".join(["query_id bigint, id bigint, similarity double", *(f"{c} {dict(vectors.dtypes)[c]}" for c in carried)]))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")).cast("bigint")) if limit else found
    return ranked.filter(F.col("place") <= limit) if limit else ranked


def comparable(vectors: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows of vectors that semantic_search compares with any query: finite, not zero, and of the length of a query that is."""
    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    usable = lambda df: df.filter((size > 0) & (size < float("inf"))).withColumn("length", F.size(vector))
    return usable(vectors).join(F.broadcast(usable(queries).select("length").distinct()), "length", "left_semi").drop("length")


def hybrid(queries: DataFrame, semantic: DataFrame, keyword: DataFrame, concept: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """One score a query and node from three searches, the best limit a query: query_id, id, score, match_types, place.

    queries: query_id. semantic: query_id, id, similarity, at most twice limit a query; keyword: id, of which the first twice
    limit by reads and time of update count; concept: id, matched; nodes: id, access_count, updated_at. match_types says
    which searches found it; equal scores go by time of update, the newest first, then id.
    """
    times = nodes.select("id", "access_count", "updated_at")
    words = keyword.select("id").join(times, "id").orderBy(F.desc("access_count"), F.desc("updated_at"), "id").limit(2 * limit).select("id")
    weighed = concept.select("id", (F.least(F.col("matched") * 0.2, F.lit(0.6)) * WEIGHTS["concept"]).alias("part"))
    # what no other search finds is in the result only if it is among the first limit of these; others found before it are few
    ideas = weighed.join(times, "id").orderBy(F.desc("part"), F.desc("updated_at"), "id").limit(5 * limit).select("id", "part")
    near = semantic.select("query_id", "id", (F.col("similarity") * WEIGHTS["semantic"]).alias("part"), F.lit("semantic").alias("kind"))
    word = queries.select("query_id").crossJoin(F.broadcast(words)).select("query_id", "id", F.lit(WEIGHTS["keyword"]).alias("part"), F.lit("keyword").alias("kind"))
    found = near.select("query_id", "id").unionByName(word.select("query_id", "id")).distinct().join(weighed, "id")
    idea = found.select("query_id", "id", "part").unionByName(queries.select("query_id").crossJoin(F.broadcast(ideas)).select("query_id", "id", "part")).distinct().withColumn("kind", F.lit("concept"))
    merged = near.unionByName(word).unionByName(idea).groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("match_types"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated_at"), "id")
    ranked = merged.join(times.select("id", "updated_at"), "id").withColumn("place", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("place") <= limit).select("query_id", "id", "score", "match_types", "place")


def is_weak(results: DataFrame) -> DataFrame:
    """For each query_id whether no hit is both semantic and found by another search."""
    both = F.col("match_types").contains("semantic") & F.col("match_types").contains("+")
    return results.groupBy("query_id").agg((~F.coalesce(F.bool_or(both), F.lit(False))).alias("weak"))


def superseded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a live node supersedes: id, by (the newest such label; of equals the largest) and what that means."""
    newer = nodes.filter("status <> 'archived'").select(F.col("id").alias("source_id"), F.col("label").alias("by_label"), F.col("created_at").alias("by_time"))
    by = edges.filter("type = 'supersedes' AND valid_to IS NULL").select("source_id", F.col("target_id").alias("id")).join(newer, "source_id").groupBy("id").agg(F.max(F.struct("by_time", "by_label"))["by_label"].alias("by_label"))
    named = F.when(F.col("type") == "dead_end", "resolved_by").otherwise("superseded_by")
    return nodes.select("id", "type").join(by, "id").select("id", "by_label", named.alias("meaning"))


def recall(nodes: DataFrame, terms: Sequence[str], now: Column, project: str | None = None, limit: int = 20) -> DataFrame:
    """Quick recall: label hits, concept hits and second hops over rare shared concepts, weighed by quality and recency.

    Label and essence hits score 1, 1.2, 1.5 and 1.8 for none, one, two and three or more terms in the label. Concept hits
    add half each up to 0.6. Of the five best, the concepts that at most a tenth of all nodes have (five at least) lead to
    further nodes, with a quarter each up to 0.75, half of it for nodes that have a score already.
    """
    label_hits = hit_count(F.lower("label"), terms)
    base = F.when(label_hits >= 3, 1.8).when(label_hits == 2, 1.5).when(label_hits == 1, 1.2).otherwise(1.0)
    word = keyword_hits(nodes, terms).select("id", base.alias("part"))
    idea = concept_hits(nodes, terms).select("id", F.least(F.col("matched") * 0.5, F.lit(0.6)).alias("part"))
    first = word.unionByName(idea).groupBy("id").agg(F.sum("part").alias("first"))
    top = first.orderBy(F.desc("first"), "id").limit(5)
    spread = nodes.select("id", F.explode(F.array_distinct("concepts")).alias("concept"))
    total = nodes.agg(F.greatest(F.lit(5), F.floor(F.count("*") * 0.1)).alias("most"))
    rare = spread.groupBy("concept").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).filter("df <= most").select("concept")
    lead = spread.join(top, "id", "left_semi").select("concept").distinct().join(rare, "concept").orderBy("concept").limit(20)
    hop = spread.join(F.broadcast(lead), "concept").groupBy("id").agg(F.least(F.count("*") * 0.25, F.lit(0.75)).alias("hop"))
    scored = first.join(hop, "id", "full_outer").select("id", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("hop", F.lit(0.0)).alias("hop"))
    joined = scored.join(nodes.select("id", "type", "ttl", "project_id", "quality", "updated_at"), "id")
    score = F.col("first") + F.when(F.col("first") > 0, F.col("hop") / 2).otherwise(F.col("hop"))
    if project:
        score = score * F.when(F.col("project_id") == project, 1.1).otherwise(1.0)
    score = score * F.when(F.col("type") == "insight", 1.3).otherwise(1.0)
    score = score * F.when(F.col("first") > 0, 0.75 + F.col("quality") / 6 * 0.25).otherwise(1.0)
    kept = joined.withColumn("raw", score).filter("raw >= 0.2 AND quality > 0")
    ranked = kept.withColumn("score", F.round(F.col("raw") * recency(F.col("updated_at"), F.col("ttl"), now), 6))
    return ranked.select("id", "first", "hop", "score").orderBy(F.desc("score"), "id").limit(limit)


def slice_candidates(nodes: DataFrame, wanted: str, k: int) -> DataFrame:
    """Nodes whose value says the same: identity 1 if equal after normalising, else half the share of common words."""
    target = primary(F.lit(wanted))
    value = primary(F.col("essence"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2))
    rank = F.when(value == target, F.lit(1.0)).otherwise(jaccard(words(value), words(target)) * 0.5)
    return nodes.select("id", F.round(rank, 6).alias("rank")).filter("rank > 0").orderBy(F.desc("rank"), "id").limit(k)


def roots_by_terms(nodes: DataFrame, roots: DataFrame, terms: Sequence[str], per_root: int = 3) -> DataFrame:
    """Entries of each top root that meet a term by concept or label, and how many terms the root's entries cover.

    roots: id and top, the top root of each project. Roots that cover more terms rank higher, then those with more entries.
    """
    wanted = F.array(*map(F.lit, terms))
    met = F.filter(wanted, lambda t: F.contains(F.lower("label"), t) | F.exists("concepts", lambda c: F.contains(F.lower(c), t)))
    entries = nodes.filter("type <> 'project'").withColumn("met", met).filter(F.size("met") > 0).join(roots.select(F.col("id").alias("project_id"), "top"), "project_id").select("id", "top", "met", "access_count")
    cover = entries.groupBy("top").agg(F.size(F.array_distinct(F.flatten(F.collect_set("met")))).cast("bigint").alias("covered"), F.count("*").alias("entries"))
    from .reads import top_in_group

    best = top_in_group(entries.withColumn("n", F.size("met").cast("bigint")), ["top"], [F.desc("n"), F.desc("access_count"), F.col("id")], per_root)
    return best.join(cover, "top").select("top", "covered", "entries", "id", "n", "place")


def stems(df: DataFrame, text: Column, key: str) -> DataFrame:
    """Distinct stems of a text's words of a-z and 0-9: key, stem and how often."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9_\-]+"), lambda w: F.length(w) > 1)
    return df.select(key, F.explode(words).alias("w")).groupBy(key, stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


def ticks(facets: DataFrame, weights: dict[str, float], terms: Sequence[str]) -> DataFrame:
    """Weighted matches of terms over facets (id, facet, token): score, at most 1 at 20 ticks, and an explanation."""
    hit = facets.filter(F.col("token").isin(list(terms))).groupBy("id", "facet").agg(F.countDistinct("token").alias("n"))
    by = F.create_map(*(F.lit(x) for p in weights.items() for x in p))
    return hit.groupBy("id").agg(F.round(F.least(F.sum(F.col("n") * by[F.col("facet")]) / 20, F.lit(1.0)) * 0.6, 6).alias("score"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "facet", F.col("n").cast("string")))), " ").alias("why"))
