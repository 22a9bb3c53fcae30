"""Scans, lists and roll-ups over nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import in_intervals

from ..sources.graph import current, live

#: Relation types and the name of each from the other end.
INVERSES = {
    "related_to": "related_to", "part_of": "contains", "contains": "part_of", "derived_from": "produced", "produced": "derived_from",
    "contradicts": "contradicts", "affects": "affected_by", "affected_by": "affects", "implements": "implemented_by", "implemented_by": "implements",
    "describes": "described_by", "described_by": "describes", "supersedes": "superseded_by", "superseded_by": "supersedes",
    "prompted_by": "triggered", "triggered": "prompted_by",
}


def by_key(nodes: DataFrame, key: str) -> DataFrame:
    """The node with this id, or with this label in any case."""
    return nodes.filter((F.col("id") == key) | (F.lower("label") == key.lower()))


def listed(nodes: DataFrame, *, type: str | None = None, status: str | None = None, since: Column | None = None, updated_since: Column | None = None, project: str | None = None, label_prefix: str | None = None, concept: str | None = None, text: str | None = None, work_status: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes that meet all given conditions, last updated first."""
    conditions = []
    if type:
        conditions.append(F.col("type") == type)
    conditions.append(F.col("status") == status if status else F.col("status") != "archived")
    if since is not None:
        conditions.append(F.col("created_at") >= since)
    if updated_since is not None:
        conditions.append(F.col("updated_at") >= updated_since)
    if project:
        conditions.append(F.col("project_id") == project)
    if label_prefix:
        conditions.append(F.col("label").startswith(label_prefix))
    if concept:
        conditions.append(F.exists("concepts", lambda c: F.contains(F.lower(c), F.lit(concept.lower()))))
    if text:
        conditions.append(F.contains(F.lower("label"), F.lit(text.lower())) | F.contains(F.lower("essence"), F.lit(text.lower())))
    if work_status:
        conditions.append(F.col("work_status") == work_status)
    found = nodes.filter(reduce(lambda a, b: a & b, conditions))
    return found.orderBy(F.col("updated_at").desc(), "id").limit(limit) if limit else found


def known_project(nodes: DataFrame, project: str) -> str:
    """The id of a project given by id or label; raises with the known labels if there is none."""
    found = by_key(nodes.filter("type = 'project'"), project).select("id").head()
    if found is None:
        known = sorted(r.label for r in nodes.filter("type = 'project'").select("label").limit(50).collect())
        raise LookupError(f"no project {project!r}; known are {', '.join(known)}")
    return found.id


def in_degree(edges: DataFrame) -> DataFrame:
    return current(edges).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))


def incoming(edges: DataFrame) -> DataFrame:
    """Edges seen from their targets: the type's inverse name where it has one."""
    names = F.create_map(*(F.lit(x) for pair in INVERSES.items() for x in pair))
    return current(edges).select(F.col("target_id").alias("id"), F.coalesce(F.element_at(names, F.col("type")), F.col("type")).alias("seen_as"), F.col("source_id").alias("other"))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels of both ends; edges of unknown nodes go."""
    a = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"))
    return edges.join(a, "source_id").join(b, "target_id")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live nodes that no current edge touches."""
    held = current(edges)
    ends = held.select(F.col("source_id").alias("id")).unionByName(held.select(F.col("target_id").alias("id")))
    return live(nodes).join(ends, "id", "left_anti")


def quality(has_kind: Column, n_fields: Column, n_concepts: Column, bonus: Column) -> Column:
    """1 to 5: one point, and one each for a kind, two fields, three concepts and the bonus."""
    points = [has_kind, n_fields >= 2, n_concepts >= 3, bonus]
    return F.least(F.lit(5), sum((F.coalesce(p, F.lit(False)).cast("int") for p in points), F.lit(1))).cast("bigint")


def staleness(updated: Column, accesses: Column, now: Column) -> Column:
    """Days since the update over ln(accesses + 2), to one place."""
    days = F.timestamp_diff("SECOND", updated, now) / F.lit(86400.0)
    return F.round(days / F.ln(accesses + F.lit(2)), 1)


def top_in_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).filter(F.col("place") <= n)


def signpost(essence: Column) -> Column:
    """What a neighbour claims, in 140 characters at most."""
    return F.when(F.length(essence) > 140, F.concat(F.substring(essence, 1, 137), F.lit("…"))).otherwise(essence)


def block_edges(blocks: DataFrame, nodes: DataFrame, edges: DataFrame, currency: DataFrame) -> DataFrame:
    """The edges of blocks (id) on both sides: id, side, type, other, other_label, gist, meaning and by_label.

    gist is what the neighbour claims; meaning and by_label say what has replaced the neighbour, if anything has (currency: id,
    by_label, meaning). An edge of a block to itself comes on both sides; neighbours that don't exist are left out.
    """
    ends = edges.select("source_id", "target_id", "type").distinct()
    out = ends.select(F.col("source_id").alias("id"), F.lit("out").alias("side"), "type", F.col("target_id").alias("other"))
    into = ends.select(F.col("target_id").alias("id"), F.lit("in").alias("side"), "type", F.col("source_id").alias("other"))
    near = out.unionByName(into).join(blocks.select("id"), "id", "left_semi")
    named = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), signpost(F.col("essence")).alias("gist"))
    marked = currency.select(F.col("id").alias("other"), "meaning", "by_label")
    return near.join(named, "other").join(marked, "other", "left").select("id", "side", "type", "other", "other_label", "gist", "meaning", "by_label")


def receipts(extractions: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Which turn ranges a block was extracted from: id, receipts (how many), first_turn and last_turn of the latest.

    extractions: id, key, turn; ranges: key, first_turn, last_turn. The latest range is the one that begins last, then ends last.
    """
    met = in_intervals(extractions, ranges, key, "turn", "first_turn", "last_turn")
    last = F.max(F.struct("first_turn", "last_turn"))
    return met.groupBy("id").agg(F.count("*").alias("receipts"), last["first_turn"].alias("first_turn"), last["last_turn"].alias("last_turn"))
