"""Upkeep over a whole graph: a sweep for settled items, conflicts of near duplicates, merges across groups, guarded links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import settled
from ..sources.graph import normal_text
from .audit import work_status
from .flags import ASKED

#: Types that can be settled, and types that report finished work.
RESOLVABLE = ("task", "blueprint")
REPORTING = ("event", "decision", "fact")
#: How a conflict may be resolved.
RESOLUTIONS = ("keep_a", "keep_b", "merge")
#: References of which an item has one of a kind at most, and types that a link between groups may have.
SINGLE = ("extends", "supersedes", "resolves")
LINKS = ("prompted_by", "based_on", "extends", "supersedes", "resolves", "supports", "contradicts", "related_to", "derived_from", "affects")


def swept(nodes: DataFrame, edges: DataFrame, flags: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Open items with what may have settled them: id, candidate, signal, scope_check and outcome.

    What supersedes an item comes first (superseded), then the newest later event, decision or fact on either side of an
    edge (neighbour); of equally new ones the smaller id. outcome is excluded (by label), none, existing (an open flag of this
    kind names the item), or flagged. nodes are the live ones, edges those that hold.
    """
    kept = nodes.select("id", "label", "type", "project_id", "created_at", "work_status")
    items = kept.filter(F.col("type").isin(*RESOLVABLE) & (work_status(F.col("work_status"))["status"] != "done"))
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("candidate"), (F.col("type") == "supersedes").alias("over")),
                F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("candidate"), F.lit(False).alias("over")),
            )
        )
    )
    near = ends.join(items.select("id", F.col("created_at").alias("opened")), "id")
    far = kept.select(F.col("id").alias("candidate"), F.col("type").alias("kind"), F.col("created_at").alias("made"), F.col("project_id").alias("far_project"))
    near = near.join(far, "candidate").filter(F.col("over") | (F.col("kind").isin(*REPORTING) & (F.col("made") > F.col("opened"))))
    order = F.struct((~F.col("over")).alias("weaker"), (-F.unix_micros(F.col("made").cast("timestamp"))).alias("age"), F.col("candidate"), F.col("far_project"))
    best = near.groupBy("id").agg(F.min(order).alias("b"))
    named = flags.filter("flag_type = 'resolution_pending' AND reviewed_at IS NULL")
    named = named.select(F.explode(F.array("block_a", "block_b")).alias("id")).filter("id IS NOT NULL").distinct().withColumn("named", F.lit(True))
    rows = items.join(best, "id", "left").join(named, "id", "left")
    off = F.col("label").isin(*exclude) if exclude else F.lit(False)
    found = F.col("b").isNotNull() & ~F.coalesce(off, F.lit(False))
    outcome = F.when(off, "excluded").when(~found, "none").when(F.col("named"), "existing").otherwise("flagged")
    show = lambda c: F.when(found, c)
    return rows.select(
        "id",
        show(F.col("b.candidate")).alias("candidate"),
        show(F.when(F.col("b.weaker"), "neighbour").otherwise("superseded")).alias("signal"),
        show(F.when(F.col("project_id") == F.col("b.far_project"), "same").otherwise("unknown")).alias("scope_check"),
        outcome.alias("outcome"),
    )


def sweep_flags(sweep: DataFrame) -> DataFrame:
    """The flags that a sweep writes, handed to the agent at once, since only it knows whether the work was done."""
    none = F.lit(None).cast("string")
    return sweep.filter("outcome = 'flagged'").select(
        F.md5(F.concat_ws("|", F.lit("resolution_pending"), "id", "candidate")).alias("flag_id"), F.lit("resolution_pending").alias("flag_type"), F.col("id").alias("block_a"), F.col("candidate").alias("block_b"),
        "scope_check", F.lit("resolution_sweep").alias("origin_writer"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.lit(ASKED).alias("verdict"), none.alias("action"), none.alias("winner"),
    )


def _pair() -> tuple[Column, Column]:
    return F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")


def conflicts_after(conflicts: DataFrame, found: DataFrame) -> DataFrame:
    """Conflicts (conflict_id, block_a, block_b, similarity, detected_at, resolution) with those found (block_a, block_b, similarity, detected_at).

    A pair in either order that has an open conflict gets no second one; of several findings of a pair the earliest counts, then the larger
    similarity, then the smaller first block. A pair whose conflicts are all resolved is a new conflict. Pairs of one block, or with a null, are none.
    """
    fresh = found.filter("block_a <> block_b").withColumns(dict(zip(("low", "high"), _pair())))
    first = fresh.groupBy("low", "high").agg(F.min(F.struct("detected_at", (-F.col("similarity")).alias("less"), "block_a", "block_b")).alias("f"))
    held = conflicts.filter("resolution IS NULL").select(*_pair()).distinct()
    new = first.join(held, ["low", "high"], "left_anti")
    ident = F.concat(F.lit("cnf_"), F.md5(F.concat_ws("|", "low", "high", F.date_format("f.detected_at", "yyyyMMddHHmmssSSSSSS"))))
    new = new.select(ident.alias("conflict_id"), "f.block_a", "f.block_b", (-F.col("f.less")).alias("similarity"), "f.detected_at", F.lit(None).cast("string").alias("resolution"))
    return conflicts.select(*new.columns).unionByName(new)


def resolved(conflicts: DataFrame, nodes: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conflicts and nodes after decisions (conflict_id, seq, said, merged_essence, reason), and the outcome of each decision.

    keep_a and keep_b archive the other node, merge gives the first the merged essence and archives the second. The first right decision of
    an open conflict counts; earlier wrong ones are BAD_RESOLUTION (no such word, or a merge without an essence), later ones and those for
    conflicts that are unknown or closed NOT_FOUND. Of several merges into a node the last by seq and conflict counts.
    """
    open_ = conflicts.filter("resolution IS NULL").select("conflict_id", "block_a", "block_b")
    right = F.coalesce(F.col("said").isin(*RESOLUTIONS) & ((F.col("said") != "merge") | (F.coalesce("merged_essence", F.lit("")) != "")), F.lit(False))
    d = decisions.withColumn("right", right).join(open_, "conflict_id", "left")
    first = d.filter("right AND block_a IS NOT NULL").groupBy("conflict_id").agg(F.min("seq").alias("first"))
    d = d.join(first, "conflict_id", "left")
    late = F.col("block_a").isNull() | (F.col("seq") > F.col("first"))
    d = d.withColumn("outcome", F.when(F.coalesce(late, F.lit(False)), "NOT_FOUND").when(~F.col("right"), "BAD_RESOLUTION").otherwise("ok"))
    did = d.filter("outcome = 'ok'")
    a, b, merges = F.col("block_a"), F.col("block_b"), F.col("said") == "merge"
    effects = did.select("seq", "conflict_id", F.inline(F.array(F.struct(F.when(F.col("said") == "keep_b", a).otherwise(b).alias("id"), F.lit(True).alias("gone"), F.lit(None).cast("string").alias("text")), F.struct(F.when(merges, a).alias("id"), F.lit(False).alias("gone"), F.col("merged_essence").alias("text")))))
    effects = effects.filter("id IS NOT NULL").groupBy("id").agg(F.max("gone").alias("gone"), F.max(F.when(F.col("text").isNotNull(), F.struct("seq", "conflict_id", "text")))["text"].alias("text"))
    n = nodes.alias("n").join(effects.select(F.col("id").alias("hit"), "gone", "text").alias("e"), F.expr("n.id = e.hit"), "left")
    after = {"status": F.when(F.col("e.gone"), "archived").otherwise(F.col("n.status")), "essence": F.coalesce("e.text", "n.essence"), "updated_at": F.when(F.col("e.hit").isNotNull(), now).otherwise(F.col("n.updated_at"))}
    n = n.select(*(after[c].alias(c) if c in after else F.col(f"n.`{c}`") for c in nodes.columns))
    closed = did.select("conflict_id", F.concat_ws(": ", "said", F.nullif("reason", F.lit(""))).alias("closed"))
    c = conflicts.join(closed, "conflict_id", "left").withColumn("resolution", F.coalesce("resolution", "closed")).select(*conflicts.columns)
    return c, n, d.select("conflict_id", "seq", "outcome")


def merged_items(items: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of one type and primary value as their first one, which takes over the references of the others.

    items (id, type, value, place, group), refs (source_id, target_id, kind). Values are compared in lower case with runs of white space as one; items without
    a value stay alone. The first is by place, then id. Both ends of each reference are moved; references to oneself and repeated ones
    go, and of a kind that an item has once only that of the earliest item stays (of the same item, the smaller target). Returns (id, into, copies, groups) for
    every item, groups being those of all copies in order, and the references.
    """
    value = normal_text(F.col("value"))
    # stored without the values, which the branches below would all read and put in order anew
    keyed = settled(items.select("id", "type", "place", "group", F.when(value != "", F.sha2(value, 256)).otherwise(F.concat(F.lit("="), "id")).alias("key")))
    firsts = keyed.groupBy("type", "key").agg(F.min(F.struct("place", "id"))["id"].alias("into"), F.count("*").alias("copies"), F.array_sort(F.collect_set("group")).alias("groups"))
    moved = settled(keyed.join(firsts, ["type", "key"]).select("id", "into", "copies", "groups", "place"))
    at = moved.select("id", "into", "place")
    source = at.select(F.col("id").alias("source_id"), F.col("into").alias("from"), "place")
    target = at.select(F.col("id").alias("target_id"), F.col("into").alias("to"))
    r = refs.select("source_id", "target_id", "kind").join(source, "source_id").join(target, "target_id", "left").withColumn("to", F.coalesce("to", "target_id"))
    r = r.filter(F.col("from") != F.col("to"))
    single = F.col("kind").isin(*SINGLE)
    many = r.filter(~single).select("from", "kind", "to").distinct()
    one = r.filter(single).groupBy("from", "kind").agg(F.min(F.struct("place", "source_id", "to"))["to"].alias("to"))
    links = many.unionByName(one.select("from", "kind", "to"))
    return moved.select("id", "into", "copies", "groups"), links.select(F.col("from").alias("source_id"), F.col("to").alias("target_id"), "kind")


def guarded(items: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed links with their outcome: added, or the first reason against it.

    items (id, group), proposed (source_id, target_id, type). Both ends must be items (unknown_id), not the same (self_link), of
    different groups (same_group, as are two without one), and the type one of ten (unknown_type).
    """
    group = lambda end: items.select(F.col("id").alias(f"{end}_id"), F.col("group").alias(f"{end}_group"), F.lit(True).alias(f"{end}_known"))
    rows = proposed.join(group("source"), "source_id", "left").join(group("target"), "target_id", "left")
    outcome = (
        F.when(F.col("source_known").isNull() | F.col("target_known").isNull(), "unknown_id")
        .when(F.col("source_id") == F.col("target_id"), "self_link")
        .when(F.equal_null("source_group", "target_group"), "same_group")
        .when(~F.coalesce(F.col("type").isin(*LINKS), F.lit(False)), "unknown_type")
        .otherwise("added")
    )
    return rows.select(*proposed.columns, outcome.alias("outcome"))
