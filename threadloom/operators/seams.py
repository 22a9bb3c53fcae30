"""Checks between the steps of an extraction: payload schemas, demotion, invariants, groups, labels, budgets, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .items import REQUIRED, checked
from .traverse import lookup

#: A type that becomes another if only what sets it apart can't be filled, and the field that is carried over.
DEMOTE = {"insight": ("fact", "observation", "value")}
#: Keys of the goal file.
GOALS = ("VISION", "MACRO", "MICRO", "TASK", "LAST", "NAV")
#: Relations within a group.
LINKS = ("prompted_by", "based_on", "extends", "supersedes", "resolves", "supports", "contradicts", "related_to", "derived_from", "affects")


def demotion(kind: Column, payload: Column) -> Column:
    """What an item becomes (type, payload), or null: only if nothing is extra and the carried field has text."""
    found = F.lit(None)
    for source, (target, field, renamed) in DEMOTE.items():
        check = checked(kind, payload)
        fits = (kind == source) & (F.size(check["missing"]) > 0) & (F.size(check["extras"]) == 0) & (F.trim(F.coalesce(F.element_at(payload, F.lit(field)), F.lit(""))) != "")
        found = F.when(fits, F.struct(F.lit(target).alias("type"), F.create_map(F.lit(renamed), F.element_at(payload, F.lit(field))).alias("payload"))).otherwise(found)
    return found


def alpha(kind: Column, payload: Column, retries: Column, own_schema: Column, most: int = 1, demotes: bool = True) -> Column:
    """proceed, route_back, demote or quarantine. Items with a schema of their own proceed; others are sent back first.

    After the retries an item is demoted where its carried field has text, whatever else is wrong with it.
    """
    check = checked(kind, payload)
    fits = (F.size(check["missing"]) == 0) & (F.size(check["extras"]) == 0)
    carried = F.lit(False)
    for source, (_, field, _) in DEMOTE.items():
        carried = carried | ((kind == source) & (F.trim(F.coalesce(F.element_at(payload, F.lit(field)), F.lit(""))) != ""))
    return F.when(F.coalesce(own_schema, F.lit(False)) | fits, "proceed").when(F.coalesce(retries, F.lit(0)) < most, "route_back").when(F.lit(demotes) & carried, "demote").otherwise("quarantine")


def beta(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = ("type", "unique", "text")) -> DataFrame:
    """Items whose read-only fields a step changed: id and the names of the fields, in their order."""
    a, b = before.alias("a"), after.alias("b")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    return a.join(b, F.col("a.id") == F.col("b.id")).select(F.col("a.id").alias("id"), changed.alias("changed")).filter(F.size("changed") > 0)


def healed(nodes: DataFrame) -> DataFrame:
    """nodes (id, type, label, payload) that need review, after demotion: id, type, label and state healed, collided or skipped.

    The type's segment of the label goes with it; labels without one, and items that fit no rule, are skipped. A label
    that is taken, or that a smaller id takes in the same pass, is a collision and stays as it was.
    """
    made = demotion(F.col("type"), F.col("payload"))
    renamed = F.regexp_replace("label", F.concat(F.lit("^(.*?)_"), F.col("type"), F.lit("_")), F.concat(F.lit("$1_"), F.col("made.type"), F.lit("_")))
    n = nodes.withColumn("made", made).withColumn("new", F.when(F.col("made").isNotNull(), renamed)).withColumn("new", F.when(F.col("new") != F.col("label"), F.col("new")))
    taken = nodes.select(F.lower("label").alias("__key"), F.lit(True).alias("__taken")).distinct()
    first = n.filter("new IS NOT NULL").groupBy(F.lower("new").alias("__key")).agg(F.min("id").alias("__first"))
    n = n.withColumn("__key", F.lower("new")).join(taken, "__key", "left").join(first, "__key", "left")
    state = F.when(F.col("new").isNull(), "skipped").when(F.col("__taken") | (F.col("__first") != F.col("id")), "collided").otherwise("healed")
    n = n.withColumn("state", F.coalesce(state, F.lit("healed")))
    done = F.col("state") == "healed"
    return n.select("id", F.when(done, F.col("made.type")).otherwise(F.col("type")).alias("type"), F.when(done, F.col("new")).otherwise(F.col("label")).alias("label"), "state")


def repaired_label(label: Column, compound: tuple[str, ...]) -> Column:
    """The label with types of several words hyphenated where they are a segment, in the middle or last."""
    for t in compound:
        hyphened = t.replace("_", "-")
        label = F.replace(label, F.lit(f"_{t}_"), F.lit(f"_{hyphened}_"))
        label = F.when(F.endswith(label, F.lit(f"_{t}")), F.concat(F.substring(label, F.lit(1), F.length(label) - len(t)), F.lit(hyphened))).otherwise(label)
    return label


def valid_segments(label: Column, types: tuple[str, ...], most: int = 4) -> Column:
    """At most so many segments, or more where the second and third, or third and fourth, are a type of two words."""
    parts = F.split(label, "_")
    pair = lambda k: F.array_join(F.slice(parts, k, 2), "_").isin(*types)
    return (F.size(parts) <= most) | pair(2) | pair(3)


def budget(floor: Column, cap: Column, credit: Column, left: Column, spent: Column) -> Column:
    """off (no guard), closed (a floor and no known balance), floor, cap or ok; credit is ok, error or unconfigured.

    The floor goes first; where no balance is configured only the cap counts.
    """
    return (
        F.when(floor.isNull() & cap.isNull(), "off")
        .when(floor.isNotNull() & (credit == "error"), "closed")
        .when((credit == "ok") & (left < floor), "floor")
        .when(spent >= cap, "cap")
        .otherwise("ok")
    )


def goal_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """KEY: value lines of each row's text: key, goal (in lower case) and value; of several of a goal the last counts."""
    line = F.posexplode(F.split(text, "\n")).alias("n", "line")
    pattern = rf"^({'|'.join(GOALS)}):\s*(.+)"
    found = rows.select(key, line).filter(F.col("line").rlike(pattern)).select(key, "n", F.lower(F.regexp_extract("line", pattern, 1)).alias("goal"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))
    return found.groupBy(key, "goal").agg(F.max_by("value", "n").alias("value"))


def issues(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """What is wrong with the groups of an extraction: group_id, local_id, severity, issue and how often.

    blocks: group_id, local_id, type, own_schema, provenance, essence, payload; links: group_id, from, to, type. Ids hold
    within their group. A block without an id, type or provenance and an id given twice are errors; the rest warns. A
    decision needs a based_on link to a block of its group.
    """
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    named = ~empty("local_id")
    check = checked(F.col("type"), F.col("payload"))
    shape = (F.size(check["missing"]) > 0) | (F.size(check["extras"]) > 0)
    known = lookup({t: True for t in REQUIRED})[F.col("type")]
    rules = [
        (~named, "error", "no_id"),
        (named & empty("type"), "error", "no_type"),
        (named & empty("provenance"), "error", "no_provenance"),
        (named & ~empty("type") & known.isNull() & ~F.coalesce("own_schema", F.lit(False)), "warning", "unknown_type"),
        (named & empty("essence"), "warning", "no_essence"),
        (named & known.isNotNull() & shape, "warning", "payload"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"))) for when, s, i in rules)))
    own = blocks.withColumn("x", F.explode(found)).select("group_id", "local_id", "x.severity", "x.issue", F.lit(1).cast("bigint").alias("n"))
    ids = blocks.filter(named).groupBy("group_id", "local_id").agg(F.count("*").alias("copies"), F.bool_or(F.coalesce(F.col("type") == "decision", F.lit(False))).alias("decides"))
    twice = ids.filter("copies > 1").select("group_id", "local_id", F.lit("error").alias("severity"), F.lit("duplicate_id").alias("issue"), (F.col("copies") - 1).alias("n"))
    here = ids.select("group_id", "local_id")
    a, b = here.select("group_id", F.col("local_id").alias("from"), F.lit(True).alias("has_from")), here.select("group_id", F.col("local_id").alias("to"), F.lit(True).alias("has_to"))
    l = links.join(a, ["group_id", "from"], "left").join(b, ["group_id", "to"], "left")  # noqa: E741
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("type").isin(*LINKS), F.lit(False)), F.struct(F.lit("unknown_link").alias("issue"), F.col("from").alias("at"))), F.when(F.col("has_from").isNull(), F.struct(F.lit("no_such_from").alias("issue"), F.col("from").alias("at"))), F.when(F.col("has_to").isNull(), F.struct(F.lit("no_such_to").alias("issue"), F.col("to").alias("at")))))
    loose = l.select("group_id", F.explode(bad).alias("x")).select("group_id", F.col("x.at").alias("local_id"), F.lit("warning").alias("severity"), "x.issue", F.lit(1).cast("bigint").alias("n"))
    based = l.filter("type = 'based_on' AND has_to").select("group_id", F.col("from").alias("local_id")).distinct()
    bare = ids.filter("decides").join(based, ["group_id", "local_id"], "left_anti").select("group_id", "local_id", F.lit("warning").alias("severity"), F.lit("no_evidence").alias("issue"), F.lit(1).cast("bigint").alias("n"))
    return own.unionByName(twice).unionByName(loose).unionByName(bare).groupBy("group_id", "local_id", "severity", "issue").agg(F.sum("n").alias("n"))


def stitched(groups: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The skeleton (result, group_id, topic, project) with what was produced: qualified ids, project, whether quarantined.

    A group with an error is emptied and stays, as one that produced nothing does: a row without an id. A group without a
    project has the most frequent one of its result (then the smallest), else its topic.
    """
    bad = found.filter("severity = 'error'").select("group_id", F.lit(True).alias("quarantined")).distinct()
    counts = groups.filter("project IS NOT NULL").groupBy("result", "project").agg(F.count("*").alias("n"))
    modal = counts.groupBy("result").agg(F.min(F.struct((-F.col("n")).alias("n"), "project"))["project"].alias("modal"))
    g = groups.join(bad, "group_id", "left").join(modal, "result", "left").select("group_id", F.coalesce("project", "modal", "topic").alias("project"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"))
    held = blocks.select("group_id", "local_id").join(bad, "group_id", "left_anti")
    return g.join(held, "group_id", "left").select("group_id", F.when(F.col("local_id").isNotNull(), F.concat_ws("::", "group_id", "local_id")).alias("qualified"), "project", "quarantined")
