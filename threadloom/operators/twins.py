"""Duplicate audits over classes of equal items: candidate pairs meet on rare words, then every rule is checked in full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard, primary
from ..sources.checkpoints import settled
from ..sources.graph import current

#: Words that carry no subject.
COMMON = (
    "the", "and", "for", "with", "this", "that", "from", "into", "your", "you", "are", "not",
    "but", "has", "was", "its", "our", "their", "other", "some", "more", "than", "then", "over",
    "onto", "only", "also", "such", "when", "what", "which", "both", "each", "per", "about",
    "these", "those", "they", "them", "have", "will", "would", "should", "could", "been",
)
#: How alike two projects' concepts are, and the shared words of two essences and of two claims.
PROJECT_JACCARD, ESSENCE_WORDS, CLAIM_WORDS = 0.6, 2, 3
#: The least cosine of two blocks of one type, and of a fact and an insight.
SAME_TYPE_COSINE, CROSS_TYPE_COSINE = 0.78, 0.80
#: Which finding stands when a pair has several.
PRECEDENCE = ("project_dup", "scope", "block_dup", "island")


def subject_words(text: Column) -> Column:
    """Distinct words of four letters or digits or more that carry a subject."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON)))


def concept_set(concepts: Column) -> Column:
    """Distinct concepts, lower case and trimmed, in order; null is none."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(concepts, F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)))))


def classes(items: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Items that agree in all of by are one class: its first id, the number of nodes and by; and the members (id, first).

    Nulls agree with each other. Both tables are stored, since every rule reads them.
    """
    keyed = items.withColumn("class", F.md5(F.to_json(F.struct(*by))))
    found = settled(keyed.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("nodes"), *(F.first(c).alias(c) for c in by)))
    members = settled(keyed.select("id", "class").join(found.select("class", "first"), "class").select("id", "first"))
    return found.drop("class"), members


def overlapping(sets: DataFrame, words: str, least: Column, by: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b of sets (first, words, by) that agree in by and may share least words; least is what a set itself needs.

    Two sets that share enough meet on one of each one's size - least + 1 rarest words, so frequent words make no pairs.
    """
    spread = sets.withColumn("room", F.size(words) - least + 1).filter((F.col("room") >= 1) & (least >= 1)).select("first", "room", *by, F.explode(words).alias("word"))
    counts = spread.groupBy("word").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("first").orderBy("df", "word"))
    rare = settled(spread.join(counts, "word").withColumn("place", place).filter("place <= room").select("first", "word", *by))
    b = rare.withColumnRenamed("first", "other")
    return rare.join(b, ["word", *by]).filter("first < other").select(F.col("first").alias("a"), F.col("other").alias("b")).distinct()


def beside(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of both classes, as structs x and y."""
    x = found.select(F.col("first").alias("a"), F.struct(*found.columns).alias("x"))
    y = found.select(F.col("first").alias("b"), F.struct(*found.columns).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def item_pairs(n: Column, m: Column) -> Column:
    """Pairs of items of two classes of n and m, or of one class beside itself."""
    return F.when(F.col("a") == F.col("b"), (n * (n - 1) / 2).cast("bigint")).otherwise(n * m)


def untied(pairs: DataFrame, members: DataFrame, edges: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Pairs of classes (a, b, x, y) with links, the item pairs between which no edge holds; those without links go.

    With new (id), only item pairs of which one is new count.
    """
    tied = current(edges).select(F.least("source_id", "target_id").alias("i"), F.greatest("source_id", "target_id").alias("j")).filter("i < j").distinct()
    ends = tied.join(members.select(F.col("id").alias("i"), F.col("first").alias("p")), "i").join(members.select(F.col("id").alias("j"), F.col("first").alias("q")), "j")
    links = item_pairs(F.col("x.nodes"), F.col("y.nodes"))
    if new is not None:
        fresh = members.join(new.select("id").distinct(), "id", "left_semi")
        per_class = fresh.groupBy("first").agg(F.count("*").alias("fresh"))
        for end in ("a", "b"):
            pairs = pairs.join(per_class.select(F.col("first").alias(end), F.col("fresh").alias(f"fresh_{end}")), end, "left").na.fill(0, [f"fresh_{end}"])
        links = links - item_pairs(F.col("x.nodes") - F.col("fresh_a"), F.col("y.nodes") - F.col("fresh_b"))
        ends = ends.join(fresh.select(F.col("id").alias("i"), F.lit(True).alias("new_i")), "i", "left").join(fresh.select(F.col("id").alias("j"), F.lit(True).alias("new_j")), "j", "left").filter("new_i OR new_j")
    held = ends.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count("*").alias("held"))
    return pairs.join(held, ["a", "b"], "left").withColumn("links", links - F.coalesce("held", F.lit(0))).filter("links > 0")


def alone(found: DataFrame) -> DataFrame:
    """Each class of several items beside itself."""
    return found.filter("nodes > 1").select(F.col("first").alias("a"), F.col("first").alias("b"))


def project_duplicates(items: DataFrame, edges: DataFrame, threshold: float = PROJECT_JACCARD, least: int = ESSENCE_WORDS) -> DataFrame:
    """Projects (id, concepts, essence) alike in concepts or in words of their essence, without an edge between them.

    One row for two classes of equal concepts and words (a, b; a = b within one class): signal, similarity, shared words and
    links, the number of project pairs. Projects without concepts and words are like none.
    """
    named = items.select("id", concept_set(F.col("concepts")).alias("cs"), F.array_sort(subject_words(F.col("essence"))).alias("ws"))
    found, members = classes(named, ("cs", "ws"))
    # x shares at least threshold * |x| concepts with anything alike; the small margin keeps rounding from losing one
    near = overlapping(found, "cs", F.ceil(F.size("cs") * F.lit(threshold) - 1e-9))
    pairs = near.union(overlapping(found, "ws", F.lit(least))).union(alone(found)).distinct()
    shared = F.size(F.array_intersect("x.ws", "y.ws")).cast("bigint")
    rows = beside(pairs, found).withColumn("similarity", jaccard(F.col("x.cs"), F.col("y.cs"))).withColumn("shared", shared)
    by_concept, by_words = F.col("similarity") >= threshold, F.col("shared") >= least
    signal = F.when(by_concept & by_words, "concept+essence").when(by_concept, "concept").when(by_words, "essence")
    kept = untied(rows.withColumn("signal", signal).filter("signal IS NOT NULL"), members, edges)
    return kept.select("a", "b", "signal", F.round("similarity", 3).alias("similarity"), "shared", "links")


def block_classes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of blocks (id, scope, type, value, concepts) that differ in nothing but their id."""
    told = blocks.select("id", "scope", "type", primary(F.col("value")).alias("value"), concept_set(F.col("concepts")).alias("cs"))
    found, members = classes(told, ("scope", "type", "value", "cs"))
    return found.withColumn("ws", subject_words(F.col("value"))), members


def word_signal(least: int) -> Column:
    """What the values of blocks x and y have in common: all, enough words of one type, or nothing (null)."""
    exact = (F.col("x.value") == F.col("y.value")) & (F.col("x.value") != "")
    return F.when(exact, "primary_value_exact").when((F.col("shared") >= least) & (F.col("x.type") == F.col("y.type")), "primary_value_overlap")


def block_pairs(found: DataFrame, least: int) -> DataFrame:
    """Pairs of classes of one scope with a signal in their values: a, b, x, y, shared, signal."""
    found = found.filter("scope IS NOT NULL")
    same = found.filter("value <> ''").select("first", "scope", "value")
    equal = same.join(same.withColumnRenamed("first", "other"), ["scope", "value"]).filter("first < other").select(F.col("first").alias("a"), F.col("other").alias("b"))
    pairs = equal.union(overlapping(found, "ws", F.lit(least), ("scope", "type"))).union(alone(found)).distinct()
    rows = beside(pairs, found).withColumn("shared", F.size(F.array_intersect("x.ws", "y.ws")).cast("bigint"))
    return rows.withColumn("signal", word_signal(least)).filter("signal IS NOT NULL")


def block_duplicates(blocks: DataFrame, edges: DataFrame, least: int = CLAIM_WORDS) -> DataFrame:
    """Blocks (id, scope, type, value, concepts) of one scope that say the same: an equal value, or enough shared words of one type.

    Blocks without a scope are twins of none. One row for two classes: signal, shared words and links, the number of block
    pairs that no edge of edges (those of supersession) ties.
    """
    found, members = block_classes(blocks)
    return untied(block_pairs(found, least), members, edges).select("a", "b", "signal", "shared", "links")


def inline_duplicates(new: DataFrame, blocks: DataFrame, similar: DataFrame, edges: DataFrame, least: int = CLAIM_WORDS) -> DataFrame:
    """As block_duplicates, for pairs of which one block is new (id), and by cosine too: two new blocks are one pair.

    similar: query_id, id, similarity, the neighbours of the new blocks. Blocks of one type, or a fact and an insight, are
    twins by cosine if their values give no signal; such a row is of two blocks, a < b.
    """
    found, members = block_classes(blocks)
    named = untied(block_pairs(found, least), members, edges, new).select("a", "b", "signal", "shared", "links")
    fresh = new.select(F.col("id").alias("query_id")).distinct()
    near = similar.join(fresh, "query_id", "left_semi").filter((F.col("similarity") >= SAME_TYPE_COSINE) & (F.col("query_id") != F.col("id")))
    pairs = near.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("similarity").alias("similarity"))
    full = settled(members.join(found.filter("scope IS NOT NULL"), "first").select("id", "scope", "type", "value", "ws")).withColumnRenamed("id", "first")
    rows = beside(pairs, full).filter("x.scope = y.scope").withColumn("shared", F.size(F.array_intersect("x.ws", "y.ws")).cast("bigint")).filter(word_signal(least).isNull())
    crossed = F.array_sort(F.array("x.type", "y.type")) == F.array(F.lit("fact"), F.lit("insight"))
    floor = F.when(F.col("x.type") == F.col("y.type"), SAME_TYPE_COSINE).when(crossed, CROSS_TYPE_COSINE)
    tied = current(edges).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    alike = rows.filter(F.col("similarity") >= floor).join(tied, ["a", "b"], "left_anti")
    return named.unionByName(alike.select("a", "b", F.lit("essence_embedding").alias("signal"), "shared", F.lit(1).cast("bigint").alias("links")))


def block_islands(blocks: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Classes of blocks that share least concepts: a, b and links, the pairs without an edge."""
    found, members = block_classes(blocks)
    rows = beside(overlapping(found, "cs", F.lit(least)).union(alone(found)), found).filter(F.size(F.array_intersect("x.cs", "y.cs")) >= least)
    return untied(rows, members, edges).select("a", "b", "links")


def scope_disagreements(blocks: DataFrame) -> DataFrame:
    """Classes of blocks of one value in different scopes: a, b and links; blocks without a value or a scope disagree with none."""
    found, _ = block_classes(blocks)
    told = found.filter("scope IS NOT NULL AND value <> ''").select("first", "scope", "value", "nodes")
    other = told.select(F.col("first").alias("b"), F.col("scope").alias("scope_b"), "value", F.col("nodes").alias("m"))
    return told.join(other, "value").filter("first < b AND scope <> scope_b").select(F.col("first").alias("a"), "b", (F.col("nodes") * F.col("m")).alias("links"))


def concept_pairs(items: DataFrame, least: int, edges: DataFrame | None = None) -> DataFrame:
    """Classes of items (id, concepts) that share least concepts: a, b (equal within one class), shared and links."""
    found, members = classes(items.select("id", concept_set(F.col("concepts")).alias("cs")), ("cs",))
    rows = beside(overlapping(found, "cs", F.lit(least)).union(alone(found)), found).withColumn("shared", F.size(F.array_intersect("x.cs", "y.cs")).cast("bigint")).filter(F.col("shared") >= least)
    none = members.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("valid_to")).limit(0)
    return untied(rows, members, none if edges is None else edges).select("a", "b", "shared", "links")


def first_findings(findings: dict[str, DataFrame]) -> DataFrame:
    """Of each pair (a, b) the finding that comes first in PRECEDENCE."""
    parts = [df.select("a", "b", F.lit(PRECEDENCE.index(name)).alias("rank")) for name, df in findings.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    names = F.array(*map(F.lit, PRECEDENCE))
    return both.groupBy("a", "b").agg(F.element_at(names, F.min("rank") + 1).alias("finding"))


def attachments(verdicts: DataFrame, roots: DataFrame) -> DataFrame:
    """What becomes of each verdict (id, decision, same_owner, matched_root, shared_subject): attach to a root, or keep.

    Attached is only what says so, has the same owner, names a root that is known (roots: label) and a shared subject.
    """
    known = roots.select(F.col("label").alias("matched_root"), F.lit(True).alias("known")).distinct()
    sure = (F.col("decision") == "attach") & F.col("same_owner") & F.col("known") & (F.col("matched_root") != "") & (F.trim("shared_subject") != "")
    rows = verdicts.join(known, "matched_root", "left").withColumn("sure", F.coalesce(sure, F.lit(False)))
    return rows.select("id", F.when(F.col("sure"), "attach").otherwise("keep").alias("action"), F.when(F.col("sure"), F.col("matched_root")).alias("root"))


def resolution(same_entity: Column, same_scope: Column, catch_all: Column) -> Column:
    """Struct of decision and reason: another entity or scope is new, the same scope is attached, an unknown owner is for review."""
    same = F.coalesce(same_entity, F.lit(False))
    decision = F.when(~same | (same_scope == "different"), "new_entity").when(same_scope == "same", "attach_existing").otherwise("flag_for_review")
    reason = F.when(decision == "flag_for_review", F.when(F.coalesce(catch_all, F.lit(False)), "catch_all_scope").otherwise("owner_unknown"))
    return F.struct(decision.alias("decision"), reason.alias("reason"))
