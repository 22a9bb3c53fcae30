"""Writes on stored nodes and edges: each finds the buckets it touches and makes only these anew.

Nodes lie in buckets by id, edges by source_id. A write is what operators.writes makes of the touched buckets; what it has to know of
other buckets (labels, ids) is looked up before, in the columns that it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import settled, settled_counted
from ..sources.versions import BUCKETS, BucketedTable
from . import writes as W
from .composites import requalified


@dataclass
class GraphTables:
    """Stored nodes and edges with their schemas."""

    nodes_table: BucketedTable
    edges_table: BucketedTable
    node_schema: object
    edge_schema: object

    def nodes(self, version: int | None = None) -> DataFrame:
        return self.nodes_table.read(self.node_schema, version)

    def edges(self, version: int | None = None) -> DataFrame:
        return self.edges_table.read(self.edge_schema, version)


def stored_graph(spark: SparkSession, folder: str, nodes: DataFrame, edges: DataFrame, buckets: int = BUCKETS) -> GraphTables:
    """nodes and edges as first versions under folder; what is there already is taken as it is."""
    g = GraphTables(BucketedTable(spark, f"{folder}/nodes", "id", buckets), BucketedTable(spark, f"{folder}/edges", "source_id", buckets), nodes.schema, edges.schema)
    for table, rows in ((g.nodes_table, nodes), (g.edges_table, edges)):
        if not table.latest():
            table.create(rows)
    return g


def create(g: GraphTables, new: DataFrame, now: Column, batch: str | None = None) -> int:
    """writes.created on stored nodes: new labels are added, known ones come back or take in payloads. A batch that is there costs nothing."""
    if g.nodes_table.taken(batch):
        return g.nodes_table.latest()
    first = settled(new.withColumn("__k", F.lower("label")).groupBy("__k").agg(F.min_by(F.struct(*new.columns), F.col("id")).alias("row")))
    held = g.nodes().select("id", F.lower("label").alias("__k")).join(first.select("__k"), "__k", "left_semi")
    held = settled(held)
    fresh = first.join(held.select("__k"), "__k", "left_anti").select("row.*")
    known = first.join(held.select("__k").distinct(), "__k", "left_semi").select("row.*")
    touched = held.select("id").unionByName(fresh.select("id"))
    # what is known by label meets it in its bucket; the label of a fresh node is in no bucket
    return g.nodes_table.rewrite(g.node_schema, touched, lambda rows: W.brought_back(rows, known, now).unionByName(fresh), batch)


def update(g: GraphTables, changes: DataFrame, now: Column, batch: str | None = None, force: bool = False) -> tuple[int, DataFrame]:
    """writes.updated on stored nodes, and the history of what changed, stored."""
    version = g.nodes_table.latest()
    before = g.nodes(version).join(changes.select("id").distinct(), "id", "left_semi")
    history = settled(W.updated(before, changes, now, force)[1])
    return g.nodes_table.rewrite(g.node_schema, changes.select("id").distinct(), lambda rows: W.updated(rows, changes, now, force)[0], batch), history


def link(g: GraphTables, new: DataFrame, batch: str | None = None) -> int:
    """writes.linked on stored edges, then the quality of their sources on stored nodes. Buckets in which nothing changes are left alone."""
    if g.edges_table.taken(batch) and g.nodes_table.taken(batch):
        return g.edges_table.latest()
    key = ["source_id", "target_id", "type"]
    ids = g.nodes().select("id")
    known = new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    known = settled(known.select(*new.columns).dropDuplicates(key))
    fresh = settled(known.join(g.edges().filter("valid_to IS NULL").select(*key), key, "left_anti").select(*g.edge_schema.names))
    version = g.edges_table.rewrite(g.edge_schema, fresh.select("source_id"), lambda rows: rows.unionByName(fresh), batch)
    # what is known and has no end holds now; only for sources without such an edge the others are looked at
    sources, ended = settled_counted(known.groupBy(F.col("source_id").alias("id")).agg(F.bool_and(F.col("valid_to").isNotNull()).alias("ended")), "ended")
    none = F.lit(None).cast("timestamp_ntz").alias("valid_to")
    out = sources.filter("NOT ended").select(F.col("id").alias("source_id"), none)
    if ended:
        rest = sources.filter("ended").select(F.col("id").alias("source_id"))
        out = settled(out.unionByName(g.edges().filter("valid_to IS NULL").select("source_id").join(rest, "source_id", "left_semi").distinct().withColumn("valid_to", none)))
    asked = g.nodes().withColumn("__before", F.col("quality")).join(sources.select("id"), "id", "left_semi")
    changed = settled(requalified(asked, out, sources).filter(~F.col("quality").eqNullSafe(F.col("__before"))).select("id"))
    g.nodes_table.rewrite(g.node_schema, changed, lambda rows: requalified(rows, out, changed), batch)
    return version


def end(g: GraphTables, gone: DataFrame, now: Column, batch: str | None = None) -> int:
    """writes.ended on stored edges."""
    return g.edges_table.rewrite(g.edge_schema, gone.select("source_id"), lambda rows: W.ended(rows, gone, now), batch)


def forget(g: GraphTables, ids: DataFrame, now: Column, batch: str | None = None) -> tuple[int, int]:
    """writes.archived on stored nodes and edges: nodes marked, their outgoing edges ended."""
    n = g.nodes_table.rewrite(g.node_schema, ids.select("id"), lambda rows: W.archived(rows, g.edges().limit(0), ids, now)[0], batch)
    closing = settled(g.edges().join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi"))
    return n, end(g, closing, now, batch)


def remember(g: GraphTables, new: DataFrame, ties: DataFrame, now: Column, batch: str | None = None) -> tuple[int, int]:
    """New nodes and their ties (source_label, target_label, type), any number at once; ties to unknown labels are left out."""
    made, tied = (None if batch is None else f"{batch}: {part}" for part in ("nodes", "ties"))
    create(g, new, now, made)
    if g.edges_table.taken(tied) and g.nodes_table.taken(tied):
        return g.nodes_table.latest(), g.edges_table.latest()
    asked = ties.select(F.explode(F.array(F.lower("source_label"), F.lower("target_label"))).alias("__k")).distinct()
    of = settled(g.nodes().select("id", F.lower("label").alias("__k")).join(asked, "__k", "left_semi").groupBy("__k").agg(F.min("id").alias("id")))
    t = ties.withColumn("__k", F.lower("source_label")).join(of.withColumnRenamed("id", "source_id"), "__k").drop("__k").withColumn("__k", F.lower("target_label")).join(of.withColumnRenamed("id", "target_id"), "__k")
    fresh = settled(t.select("source_id", "target_id", "type", F.lit("active").alias("status"), now.alias("created_at"), now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to")))
    version = link(g, fresh, tied)
    return g.nodes_table.latest(), version
