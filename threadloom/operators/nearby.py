"""Neighbourhoods of many new nodes at once: ranked slices of the graph, quotas over tiers, duplicates and conflicts by vector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import cosine
from ..functions.text import primary, scope_segment
from ..sources.checkpoints import settled
from . import cells
from .grams import contained
from .reads import top_in_group

#: Weights of an equal value, of common words and of the cosine, and the cosine that stands alone.
EXACT, PARTIAL, SEMANTIC, ALONE = 1.0, 0.5, 0.2, 0.5
#: The scope of what belongs nowhere, and how a root says that it gathers such.
NOWHERE = "unspecified-project"
CATCH_ALL = r"without a specified project|miscellaneous|uncategorized|catch-?all|unspecified"
#: Types that are always shown, those that a dead end may replace, cosines of alerts, of a match and of a conflict.
ALWAYS = ("dead_end", "constraint")
REPLACEABLE = ("decision", "blueprint")
WEIGHTY = ("decision", "constraint", "dead_end", "blueprint")
STRONG, RELATED, MATCH, CONFLICT = 0.88, 0.72, 0.72, 0.85


def value_words(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(value, " "), lambda w: F.length(w) > 2))


def identities(asked: DataFrame, there: DataFrame) -> DataFrame:
    """asked, there and identity of distinct values (value) that are equal or share words of three letters or more."""
    a = asked.select(F.col("value").alias("asked")).filter("asked <> ''").distinct()
    b = there.select(F.col("value").alias("there")).filter("there <> ''").distinct()
    words = lambda df, c: df.select(c, F.size(value_words(F.col(c))).alias(f"n_{c}"), F.explode(value_words(F.col(c))).alias("word"))
    shared = words(a, "asked").join(words(b, "there"), "word").groupBy("asked", "there", "n_asked", "n_there").agg(F.count("*").alias("both"))
    partial = shared.filter("asked <> there").select("asked", "there", (F.col("both") / (F.col("n_asked") + F.col("n_there") - F.col("both")) * PARTIAL).alias("identity"))
    return partial.unionByName(a.join(b, a["asked"] == b["there"]).select("asked", "there", F.lit(EXACT).alias("identity")))


def graph_slices(nodes: DataFrame, queries: DataFrame, k: int, roots: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The k best candidates of each query: query_id, id, identity, semantic, rank, scope, catch_all and place.

    nodes: id, label, essence, concepts. queries: query_id, value, concepts; a query isn't its own candidate. vectors: id, v, for
    nodes and queries by their ids. rank is the identity plus a fifth of the cosine. Candidates share words of the value, or
    a concept of which one contains the other; those with neither rank nor a cosine of ALONE are left out. Equal ranks go by
    id. Values are ranked before nodes are: of each query's values only those that may still be among its k best are taken
    apart into nodes, and concepts are looked at only for queries whose words don't fill their places.
    """
    known = nodes.select("id", "label", "concepts", primary(F.col("essence")).alias("there"))
    asking = queries.select("query_id", "concepts", primary(F.col("value")).alias("asked"))
    ranked = identities(asking.select(F.col("asked").alias("value")), known.select(F.col("there").alias("value")))
    sizes = known.groupBy("there").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("asked").orderBy(F.desc("identity"), "there").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.join(sizes, "there").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    # a cosine moves a rank by SEMANTIC up or down, so values within twice that of the last sure one may still come in
    last = F.min(F.when(F.col("before") <= k, F.col("identity"))).over(Window.partitionBy("asked"))
    ranked = ranked.withColumn("last", last).filter(F.col("identity") >= F.col("last") - (0.0 if vectors is None else 2 * SEMANTIC))
    members = known.select("id", "there")
    # nodes of one value without a vector differ by id only, so no more of them are met than there are places (and the query itself)
    plain = members if vectors is None else members.join(vectors.select("id"), "id", "left_anti")
    plain = top_in_group(plain, ["there"], [F.col("id")], k + 1).drop("place")
    members = plain if vectors is None else members.join(vectors.select("id"), "id", "left_semi").select("id", "there").unionByName(plain.select("id", "there"))
    found = asking.select("query_id", "asked").join(ranked.select("asked", "there", "identity"), "asked").join(members, "there").select("query_id", "id", "identity")

    def weighed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(F.col("query_id") != F.col("id"))
        if vectors is None:
            pairs = pairs.withColumn("semantic", F.lit(0.0))
        else:
            of = lambda c, v: vectors.select(F.col("id").alias(c), F.col("v").alias(v))
            pairs = pairs.join(of("id", "v1"), "id", "left").join(of("query_id", "v2"), "query_id", "left").withColumn("semantic", cosine(F.col("v1"), F.col("v2"))).drop("v1", "v2")
        return pairs.withColumn("rank", F.col("identity") + F.least("semantic", F.lit(1.0)) * SEMANTIC).filter((F.col("rank") > 0) | (F.col("semantic") >= ALONE))

    found = weighed(found)
    if vectors is not None:
        found = settled(found)
        full = found.filter(F.col("rank") > SEMANTIC).groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        spare = asking.join(full, "query_id", "left_anti").join(vectors.select(F.col("id").alias("query_id")), "query_id", "left_semi")
        mine = spare.select("query_id", F.explode(F.array_distinct(F.transform("concepts", lambda c: F.lower(c)))).alias("mine"))
        theirs = known.select("id", F.explode(F.array_distinct(F.transform("concepts", lambda c: F.lower(c)))).alias("theirs")).join(vectors.select("id"), "id", "left_semi")
        one, two = mine.select("mine").distinct(), theirs.select("theirs").distinct()
        pairs = contained(one, two, "mine", "theirs").toDF("mine", "theirs").unionByName(contained(two, one, "theirs", "mine").select(F.col("string").alias("mine"), F.col("needle").alias("theirs"))).distinct()
        more = mine.join(pairs, "mine").join(theirs, "theirs").select("query_id", "id").distinct()
        more = more.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("identity", F.lit(0.0))
        found = found.unionByName(weighed(more).select(*found.columns))
    best = top_in_group(found, ["query_id"], [F.desc(F.round("rank", 9)), F.col("id")], k)
    scoped = best.join(known.select("id", scope_segment(F.col("label")).alias("scope")), "id")
    gathering = roots.filter(F.lower("essence").rlike(CATCH_ALL)).select(F.col("label").alias("scope"), F.lit(True).alias("catch_all")).distinct()
    return scoped.join(gathering, "scope", "left").withColumn("catch_all", F.coalesce("catch_all", F.col("scope") == NOWHERE)).select("query_id", "id", "identity", "semantic", "rank", "scope", "catch_all", "place")


def quotas(tiers: list[tuple[str, DataFrame]], cap: int) -> DataFrame:
    """anchor, id, tier and place: of several ranked sources (anchor, id, place) the first cap of each anchor.

    Earlier tiers come first, whole; what several have counts in the first of them.
    """
    rows = reduce(DataFrame.unionByName, (df.select("anchor", "id", F.lit(n).alias("tier"), "place") for n, (_, df) in enumerate(tiers)))
    first = rows.groupBy("anchor", "id").agg(F.min(F.struct("tier", "place")).alias("at"))
    names = F.array(*(F.lit(name) for name, _ in tiers))
    return top_in_group(first, ["anchor"], [F.col("at"), F.col("id")], cap).select("anchor", "id", F.get(names, F.col("at.tier")).alias("tier"), "place")


def memberships(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """id and root of every node: its project, and the project that its label begins with."""
    named = nodes.select("id", scope_segment(F.col("label")).alias("label")).join(roots.select("label", F.col("id").alias("root")), "label").select("id", "root")
    return nodes.select("id", F.col("project_id").alias("root")).join(roots.select(F.col("id").alias("root")), "root", "left_semi").select("id", "root").unionByName(named).distinct()


def neighbourhoods(anchors: DataFrame, nodes: DataFrame, roots: DataFrame, related: DataFrame, vectors: DataFrame, index: cells.CellIndex, cap: int = 120, net: int = 5, near: int = 5, least: float = ALONE) -> DataFrame:
    """What surrounds each anchor: anchor, id, tier and place, cap at most, and near more that only vectors find.

    anchors: id, label, project_id, essence, concepts. nodes: the same with updated_at, no projects. related: root_a and root_b. vectors:
    vec_id, id, v of nodes and anchors, which index holds by vec_id. Tier member: nodes of the anchor's roots and of roots that these
    are related to, the newest first. Tier net: the net best by words, where members leave room. Tier near: of what is not
    among these the nearest by cosine, from least on; it has a place of its own. Anchors of one root share its members, and a
    root hands over cap + 1 at most, so no anchor meets a whole root.
    """
    of = memberships(nodes, roots)
    new = F.struct(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.col("id"))
    newest = top_in_group(of.join(nodes.select("id", "updated_at"), "id"), ["root"], [new], cap + 1).drop("place")
    pairs = related.select("root_a", "root_b").unionByName(related.select(F.col("root_b").alias("root_a"), F.col("root_a").alias("root_b")))
    mine = settled(memberships(anchors, roots).withColumnRenamed("id", "anchor"))
    # anchors of the same roots have the same members
    groups = mine.groupBy("anchor").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    sets = groups.select("roots").distinct().select("roots", F.explode("roots").alias("root_a"))
    wide = sets.select("roots", F.col("root_a").alias("root")).unionByName(sets.join(pairs, "root_a").select("roots", F.col("root_b").alias("root"))).distinct()
    shared = top_in_group(wide.join(newest, "root").select("roots", "id", "updated_at").distinct(), ["roots"], [new], cap + 1)
    members = groups.join(shared, "roots").filter(F.col("anchor") != F.col("id")).select("anchor", "id", "place")
    members = settled(top_in_group(members.withColumnRenamed("place", "p"), ["anchor"], [F.col("p")], cap).select("anchor", "id", "place"))
    full = members.groupBy(F.col("anchor").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= cap)
    room = anchors.join(full, "id", "left_anti").select(F.col("id").alias("query_id"), F.col("essence").alias("value"), "concepts")
    slices = graph_slices(nodes, room, net, roots).select(F.col("query_id").alias("anchor"), "id", "place")
    surfaced = settled(quotas([("member", members), ("net", slices)], cap))
    return surfaced.unionByName(meaning(anchors, nodes, vectors, index, surfaced, near, least))


def meaning(anchors: DataFrame, nodes: DataFrame, vectors: DataFrame, index: cells.CellIndex, surfaced: DataFrame, near: int, least: float) -> DataFrame:
    asked = vectors.join(anchors.select("id"), "id", "left_semi").select("vec_id", F.col("v").alias("embedding"))
    names = vectors.select("vec_id", "id")
    # only what surrounds anchors that have a vector can be found again; all of it is many times what its file makes Spark expect
    surfaced = surfaced.join(vectors.select(F.col("id").alias("anchor")), "anchor", "left_semi").select("anchor", "id")
    hits = cells.within(index, asked, least).join(names.select(F.col("vec_id").alias("query_id"), F.col("id").alias("anchor")), "query_id").join(names.select(F.col("vec_id").alias("other"), F.col("id").alias("node")), F.col("id") == F.col("other"))
    hits = hits.select("anchor", F.col("node").alias("id"), "similarity").filter("anchor <> id").join(nodes.select("id"), "id", "left_semi").join(surfaced.hint("merge"), ["anchor", "id"], "left_anti")
    return top_in_group(hits, ["anchor"], [F.desc(F.round("similarity", 9)), F.col("id")], near).select("anchor", "id", F.lit("near").alias("tier"), "place")


def duplicate_alerts(items: DataFrame, index: cells.CellIndex) -> DataFrame:
    """vec_id, nearest, similarity and alert of each item (vec_id, embedding, kind): the nearest of its kind, how near.

    index is grouped by kind. Strong from STRONG on, related from RELATED; an item that has nothing so near gives no row. Equal
    similarities, to six digits, go by id.
    """
    hits = cells.within(index, items, RELATED, group="kind").filter("query_id <> id")
    best = hits.groupBy(F.col("query_id").alias("vec_id")).agg(F.min_by(F.struct("id", "similarity"), F.struct(-F.round("similarity", 6), "id")).alias("b"))
    return best.select("vec_id", F.col("b.id").alias("nearest"), F.col("b.similarity").alias("similarity"), F.when(F.col("b.similarity") >= STRONG, "strong").otherwise("related").alias("alert"))


def presearch(items: DataFrame, blocks: DataFrame, index: cells.CellIndex, recent: int = 8) -> DataFrame:
    """What is shown beside each item (item, project, vec_id, embedding): item, id, why and place.

    blocks: id, vec_id (null: no vector), kind, project, created_at. Blocks of the item's project: all of a kind in ALWAYS (why
    anchor, by id), the nearest other one from MATCH on (match), and of decisions not among these the recent newest (recent).
    index holds the blocks' vectors grouped by project.
    """
    blocks = blocks.select("id", "vec_id", "kind", "project", "created_at")
    kept = blocks.filter(F.col("kind").isin(*ALWAYS)).withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("id")).cast("bigint"))
    anchors = items.select("item", "project").join(kept, "project").select("item", "id", F.lit("anchor").alias("why"), "place")
    others = blocks.filter(~F.col("kind").isin(*ALWAYS))
    hits = cells.within(index, items, MATCH, group="project").join(items.select(F.col("vec_id").alias("query_id"), "item"), "query_id").withColumnRenamed("id", "vec_id")
    match = top_in_group(hits.join(others.select("vec_id", "id"), "vec_id").filter("item <> id"), ["item"], [F.desc(F.round("similarity", 6)), F.col("id")], 1).select("item", "id", F.lit("match").alias("why"), "place")
    match = settled(match)
    # one may be the match and one the item itself
    newest = top_in_group(others.filter("kind = 'decision'"), ["project"], [F.desc("created_at"), F.col("id")], recent + 2).drop("place")
    rest = items.select("item", "project").join(newest, "project").filter("item <> id").join(match.select("item", "id"), ["item", "id"], "left_anti")
    last = top_in_group(rest, ["item"], [F.desc("created_at"), F.col("id")], recent).select("item", "id", F.lit("recent").alias("why"), "place")
    return anchors.unionByName(match).unionByName(last)


def conflicts(items: DataFrame, blocks: DataFrame, index: cells.CellIndex, stop: list[str]) -> DataFrame:
    """What each dead end (item, text, vec_id, embedding) may replace: item, id and why, one each at most.

    blocks: id, label, vec_id of the replaceable kinds, which index holds. The first word of the text, of four letters or more and
    not in stop, that the label of a block contains gives the block (the smallest id); else the nearest vector above CONFLICT.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(*stop))
    nouns = items.select("item", F.posexplode(words).alias("at", "noun"))
    held = contained(nouns.select("noun"), blocks.select("label"), "noun", "label").join(blocks.select(F.col("label").alias("string"), "id"), "string").groupBy(F.col("needle").alias("noun")).agg(F.min("id").alias("id"))
    by_label = settled(nouns.join(held, "noun").groupBy("item").agg(F.min(F.struct("at", "id")).alias("b")).select("item", F.col("b.id").alias("id"), F.lit("label").alias("why")))
    left = items.join(by_label.select("item"), "item", "left_anti")
    hits = cells.within(index, left, CONFLICT).filter(F.col("similarity") > CONFLICT).join(left.select(F.col("vec_id").alias("query_id"), "item"), "query_id").withColumnRenamed("id", "vec_id")
    near = top_in_group(hits.join(blocks.select("vec_id", "id"), "vec_id"), ["item"], [F.desc(F.round("similarity", 6)), F.col("id")], 1).select("item", "id", F.lit("semantic").alias("why"))
    return by_label.unionByName(near)
