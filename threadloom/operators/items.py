"""Deterministic seams over extracted items: twins, folds, merges, validation, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .traverse import reached

#: The payload key that carries a type's value, and the keys a type needs.
PRIMARY = {"fact": ["value"], "decision": ["choice"], "dead_end": ["approach", "dropped", "reason"], "constraint": ["limit", "requirement"], "blueprint": ["purpose"], "insight": ["observation"], "preference": ["lean"], "hypothesis": ["proposal"], "artifact": ["path"]}
REQUIRED = {
    "decision": ["choice"], "dead_end": ["approach", "reason"], "constraint": ["limit"], "blueprint": ["purpose"], "preference": ["lean"], "chain": ["arc"], "fact": ["value"],
    "insight": ["observation", "implication"], "task": ["status", "description"], "question": ["question"], "hypothesis": ["proposal"], "entity": ["name"], "artifact": ["path"], "event": ["what_happened"],
}
OPTIONAL = {
    "decision": ["reason", "alternatives_rejected"], "dead_end": ["alternative"], "constraint": ["reason", "source"], "blueprint": ["status", "trigger_to_implement"], "preference": ["over", "condition"], "chain": ["conclusion"], "fact": ["why_matters"],
    "insight": [], "task": ["owner"], "question": ["why_matters"], "hypothesis": ["evidence_for", "evidence_against"], "entity": ["role"], "artifact": ["description"], "event": ["outcome", "date"],
}


def primary_value(kind: Column, payload: Column) -> Column:
    """The value of a payload map: its type's key if it has one with text, else the first key by name that has; trimmed."""
    text = lambda k: F.nullif(F.trim(F.element_at(payload, F.lit(k))), F.lit(""))
    own = None
    for t, keys in PRIMARY.items():
        value = F.coalesce(*map(text, keys))
        own = F.when(kind == t, value) if own is None else own.when(kind == t, value)
    rest = F.array_sort(F.filter(F.map_entries(payload), lambda e: F.trim(e["value"]) != ""))
    return F.coalesce(own, F.trim(F.get(rest, F.lit(0))["value"]))


def checked(kind: Column, payload: Column) -> Column:
    """Struct of missing and extra keys of a payload by its type; types without a schema have neither."""
    table = lambda d: F.create_map(*(x for t, ks in d.items() for x in (F.lit(t), F.array(*map(F.lit, ks)).cast("array<string>"))))
    need, may = table(REQUIRED)[kind], table(OPTIONAL)[kind]
    keys = F.map_keys(payload)
    full = F.filter(need, lambda k: F.coalesce(F.trim(F.element_at(payload, k)), F.lit("")) != "")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(F.array_sort(F.array_except(need, full)), none).alias("missing"), F.coalesce(F.array_sort(F.array_except(keys, F.array_union(need, may))), none).alias("extras"))


def twins(items: DataFrame, text: Column) -> DataFrame:
    """Items (id, type, degree) with the same text and at least two types: each with the winner of its group.

    Wired items win over others, then those that are no fact, then the smallest id.
    """
    keyed = items.withColumn("key", F.md5(text))
    best = F.min(F.struct((F.col("degree") == 0).alias("loose"), (F.col("type") == "fact").alias("fact"), F.col("id")))["id"]
    groups = keyed.groupBy("key").agg(best.alias("winner"), F.count("*").alias("copies"), F.countDistinct("type").alias("types")).filter("types > 1")
    return keyed.join(groups, "key").select("id", "winner", "copies")


def first_of(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Items with the first of their group by order, and whether they are later ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("first", F.first("id").over(w)).withColumn("repeat", F.col("first") != F.col("id"))


def folds(refs: DataFrame, items: DataFrame) -> DataFrame:
    """Facts that are absorbed: referred to once, by based_on, from a decision, dead end or constraint, and referring to nothing."""
    once = refs.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"), F.first("source_id").alias("into"), F.first("type").alias("how")).filter("n = 1 AND how = 'based_on'")
    leaf = items.filter("type = 'fact'").select("id").join(refs.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    takers = items.filter(F.col("type").isin("decision", "dead_end", "constraint")).select(F.col("id").alias("into"))
    return leaf.join(once, "id").join(takers, "into").select("id", "into")


def rescued(items: DataFrame, refs: DataFrame, kept: DataFrame) -> DataFrame:
    """Items that stay: those kept, and all that a staying item refers to, to any depth."""
    return items.select("id").join(reached(refs, kept), "id", "left_semi")


def role_context(refs: DataFrame, items: DataFrame) -> DataFrame:
    """Types that need an item and types it builds on, with counts, as one line each."""
    kind = items.select("id", "type")
    needs = refs.join(kind.select(F.col("id").alias("source_id"), F.col("type").alias("t")), "source_id").select(F.col("target_id").alias("id"), F.lit("needed_by").alias("side"), "t")
    builds = refs.join(kind.select(F.col("id").alias("target_id"), F.col("type").alias("t")), "target_id").select(F.col("source_id").alias("id"), F.lit("builds_on").alias("side"), "t")
    counts = needs.unionByName(builds).groupBy("id", "side", "t").agg(F.count("*").alias("n"))
    return counts.groupBy("id", "side").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "t", "n"))), " ").alias("types"))


def batched(items: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """Items in batches of a size within their group, in order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return items.withColumn("batch", F.floor(place / size).cast("bigint"))


def window_around(text: Column, needles: list[str], width: int) -> Column:
    """width characters around the first needle that the text has, in order of needles; null if it has none."""
    at = F.lit(None).cast("int")
    for n in reversed(needles):
        at = F.when(F.instr(text, n) > 0, F.instr(text, n)).otherwise(at)
    return F.when(at.isNotNull(), F.substring(text, F.greatest(F.lit(1), at - width // 2), F.lit(width)))


def _spare(df: DataFrame, name: str) -> str:
    """name with as many underscores before it as make it no column of df."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def _columns(df: DataFrame) -> list[Column]:
    """The names of df's columns, to be selected whatever signs they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def prefilled(first: DataFrame, second: DataFrame) -> DataFrame:
    """Items of the second pass with what the first knew: extends is filled where it is empty, a changed type without a reason is stamped.

    first (arc, id, type, extends; one row an item), second (arc, id, type, extends, review_reason and more). Reasons that are given stay; items that the first pass did not
    have, or gave no type, get no stamp.
    """
    was, had = _spare(second, "was"), _spare(second, "had")
    knew = first.select("arc", "id", F.nullif("type", F.lit("")).alias(was), F.nullif("extends", F.lit("")).alias(had))
    rows = second.join(knew, ["arc", "id"], "left")
    stamp = (F.col(was) != F.col("type")) & (F.coalesce("review_reason", F.lit("")) == "")
    after = {"extends": F.coalesce(F.nullif("extends", F.lit("")), had, "extends"), "review_reason": F.when(stamp, "type_override").otherwise(F.col("review_reason"))}
    return rows.withColumns(after).select(*_columns(second))


def recovered(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks (arc, n, is_a, from_item) whose item is unknown with the first unclaimed item of their arc and type: all columns, and drifted.

    items (arc, id, type, place). A known item is never reassigned, and what a block claims no other gets; the k-th block of a type that drifted takes the k-th
    item of it that no block claims. Where there are too few, from_item stays as it was. Windows are of one type in one arc.
    """
    known, match, k = (_spare(blocks, name) for name in ("known", "match", "k"))
    b = blocks.join(items.select("arc", F.col("id").alias("from_item"), F.lit(True).alias(known)).distinct(), ["arc", "from_item"], "left")
    free = items.join(b.filter(F.col(known)).select("arc", F.col("from_item").alias("id")).distinct(), ["arc", "id"], "left_anti")
    place = lambda by, *order: F.row_number().over(Window.partitionBy("arc", by).orderBy(*order))
    free = free.select("arc", F.col("type").alias("is_a"), F.col("id").alias(match), place("type", "place", "id").alias(k))
    lost = b.filter(F.col(known).isNull()).withColumn(k, place("is_a", "n")).join(free, ["arc", "is_a", k], "left")
    done = b.filter(F.col(known)).withColumn(match, F.lit(None).cast("string")).unionByName(lost.drop(k))
    return done.withColumn("from_item", F.coalesce(match, "from_item")).select(*_columns(blocks), F.col(match).isNotNull().alias("drifted"))
