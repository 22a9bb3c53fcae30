"""Tools that write several tables at once: each takes the current tables and gives the next ones.

nodes may carry payload (map<string,string>), chain_id and flow_role; where a column is missing, that part is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reads import quality
from .writes import archived, created, linked, updated

#: Words of five letters or more that say nothing of what a conclusion is about, so that no tag is made of them.
NO_TAGS = tuple(
    "about above after again against although always among another because before being below between could during either every further having however instead itself might neither never often other "
    "ought quite rather shall should since something still their theirs themselves there therefore these thing things those though through toward towards under unless until using usually where whether "
    "which while whose within without would yours".split()
)


def requalified(nodes: DataFrame, edges: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """nodes with the quality of sources (id) counted anew; those at the most already stay.

    A point each for being there, a kind, two payload keys, three concepts and an outgoing edge that holds.
    """
    out = edges.filter("valid_to IS NULL").select(F.col("source_id").alias("id"), F.lit(True).alias("__out")).distinct()
    asked = sources.select("id", F.lit(True).alias("__asked")).distinct()
    keys = F.size(F.map_keys("payload")) if "payload" in nodes.columns else F.lit(0)
    kind = F.element_at("payload", F.lit("is_a")).isNotNull() if "payload" in nodes.columns else F.lit(False)
    new = quality(kind, keys - kind.cast("int"), F.size("concepts"), F.col("__out"))
    n = nodes.join(asked, "id", "left").join(out, "id", "left")
    return n.withColumn("quality", F.when(F.col("__asked") & (F.coalesce("quality", F.lit(0)) < most), new).otherwise(F.col("quality"))).select(*nodes.columns)


def related(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next nodes and edges after new edges: those with both ends and not there yet are added, their sources' quality counted."""
    after = linked(edges, new, nodes)
    return requalified(nodes, after, new.select(F.col("source_id").alias("id"))), after


def remembered(nodes: DataFrame, edges: DataFrame, new: DataFrame, ties: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Next nodes and edges after new nodes, any number at once, and their ties (source_label, target_label, type).

    Labels of either end may be old or new; a tie whose end is unknown is left out. Old nodes of a new label take in its
    payload. New nodes' quality is counted with their ties.
    """
    after = created(nodes, new, now)
    of = after.groupBy(F.lower("label").alias("__k")).agg(F.min("id").alias("id"))
    a, b = of.withColumnRenamed("id", "source_id"), of.withColumnRenamed("id", "target_id")
    t = ties.withColumn("__k", F.lower("source_label")).join(a, "__k").drop("__k").withColumn("__k", F.lower("target_label")).join(b, "__k")
    fresh = t.select("source_id", "target_id", "type", F.lit("active").alias("status"), now.alias("created_at"), now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    all_edges = linked(edges, fresh, after)
    return requalified(after, all_edges, after.join(new.select(F.lower("label").alias("__k")), F.lower(after["label"]) == F.col("__k"), "left_semi").select("id")), all_edges


def tags_of(conclusion: Column, most: int = 6) -> Column:
    """Distinct words of five letters or more that are no function words, the first most."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(conclusion, F.lit(""))), "[^a-z0-9]", " "), " +")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 4) & ~w.isin(*NO_TAGS))), 1, most)


def derived(nodes: DataFrame, edges: DataFrame, made: DataFrame, now: Column, most: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next nodes and edges after conclusions, and stamps (id, chain_id, flow_role) of them and their inputs.

    made: id, label, conclusion, inputs (ids), concepts, type, promote; inputs that repeat count once. A conclusion with an unknown
    input, or with none, is refused: it gives no rows. Without concepts of its own it has those of its inputs, in the
    inputs' order, most at most; if they have none either, words of the conclusion. It lasts unless promote is false. A node
    that several conclusions use has the chain of the last by id.
    """
    m = made.withColumn("inputs", F.array_distinct("inputs"))
    flat = m.select(F.col("id").alias("made"), F.posexplode("inputs").alias("at", "id")).join(nodes.select("id", "concepts"), "id")
    known = flat.groupBy("made").agg(F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "concepts"))), lambda x: x["concepts"])).alias("theirs"))
    m = m.join(known, F.col("id") == F.col("made")).filter(F.size("inputs") == F.col("n"))
    theirs = F.slice(F.array_distinct("theirs"), 1, most)
    own = F.coalesce("concepts", F.array().cast("array<string>"))
    tags = F.when(F.size(own) > 0, own).when(F.size(theirs) > 0, theirs).otherwise(tags_of(F.col("conclusion")))
    given = {
        "id": F.col("id"), "label": F.coalesce("label", F.concat(F.lit("derived_"), "id")), "type": F.coalesce("type", F.lit("insight")), "status": F.lit("active"),
        "ttl": F.when(~F.coalesce("promote", F.lit(True)), "session").otherwise("permanent"), "essence": F.col("conclusion"), "concepts": tags, "created_at": now, "updated_at": now,
        "access_count": F.lit(0), "quality": F.least(F.lit(5), 4 + (F.size(tags) >= 3).cast("int")),
        "payload": F.create_map(F.lit("conclusion"), F.col("conclusion"), F.lit("input_count"), F.col("n").cast("string")),
    }
    fresh = m.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema))
    ties = m.select("id", F.explode("inputs").alias("target_id")).select(F.col("id").alias("source_id"), "target_id", F.lit("derived_from").alias("type"), F.lit("active").alias("status"), now.alias("created_at"), now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    chain = F.concat(F.lit("chain_"), F.col("source_id"))
    stamps = ties.select(F.col("target_id").alias("id"), chain.alias("chain_id"), F.lit("cause").alias("flow_role")).unionByName(ties.select(F.col("source_id").alias("id"), chain.alias("chain_id"), F.lit("outcome").alias("flow_role")).distinct())
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("chain_id"), F.desc("flow_role")))
    after = created(nodes, fresh, now)
    return after, linked(edges, ties, after), stamps.withColumn("__n", last).filter("__n = 1").drop("__n")


def challenged(nodes: DataFrame, edges: DataFrame, disputes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Next nodes and edges after disputes (id of the challenge, target, reasoning): a note that challenges each known target."""
    t = disputes.join(nodes.select(F.col("id").alias("target"), "label", "essence"), "target")
    given = {
        "id": F.col("id"), "label": F.substring(F.concat(F.lit("challenge_to_"), "label"), 1, 60), "type": F.lit("note"), "status": F.lit("created"), "ttl": F.lit("project"),
        "essence": F.concat(F.lit("Challenge to: "), F.coalesce("essence", F.lit(""))), "concepts": F.array(), "created_at": now, "updated_at": now, "access_count": F.lit(0), "quality": F.lit(1),
        "payload": F.create_map(F.lit("dispute_reasoning"), F.col("reasoning"), F.lit("challenged_block_id"), F.col("target")),
    }
    fresh = t.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema))
    after = created(nodes, fresh, now)
    of = after.select(F.lower("label").alias("__k"), F.col("id").alias("source_id"))
    ties = t.withColumn("__k", F.lower(F.substring(F.concat(F.lit("challenge_to_"), "label"), 1, 60))).join(of, "__k").select("source_id", F.col("target").alias("target_id"), F.lit("challenges").alias("type"), F.lit("active").alias("status"), now.alias("created_at"), now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    hit = t.select(F.col("target").alias("id"), F.lit(True).alias("__hit")).distinct()
    touched = after.join(hit, "id", "left").withColumn("updated_at", F.when(F.col("__hit"), now).otherwise(F.col("updated_at")))
    return touched.select(*nodes.columns), linked(edges, ties, after)


def resolved(nodes: DataFrame, edges: DataFrame, actions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next nodes and edges after actions (id, action, other), and the outcome of each.

    keep_this archives the other node, keep_other and archive_this the node itself. Unknown nodes, a missing other and
    unknown actions change nothing.
    """
    known = nodes.select("id", F.lit(True).alias("has")).distinct()
    a = actions.join(known, "id", "left").join(known.select(F.col("id").alias("other"), F.col("has").alias("has_other")), "other", "left")
    pair = F.coalesce(F.col("action").isin("keep_this", "keep_other"), F.lit(False))
    outcome = F.when(F.col("has").isNull(), "BLOCK_NOT_FOUND").when(pair & F.col("has_other").isNull(), "OTHER_REQUIRED").when(pair | F.coalesce(F.col("action") == "archive_this", F.lit(False)), "ok").otherwise("INVALID_ACTION")
    a = a.withColumn("outcome", outcome)
    gone = a.filter("outcome = 'ok'").select(F.when(F.col("action") == "keep_this", F.col("other")).otherwise(F.col("id")).alias("id"))
    after = archived(nodes, edges, gone, now)
    return *after, a.select("id", "action", "other", "outcome")


def forgotten(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes archived and their outgoing edges ended; nothing is deleted."""
    return archived(nodes, edges, ids, now)


def kept(nodes: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Next nodes after those with these ids (id, and label and type or null) became permanent, and the history.

    Nodes that are permanent already stay as they are, label and type included.
    """
    open_ = ids.join(nodes.filter("ttl <> 'permanent'").select("id"), "id", "left_semi")
    one = lambda field, value: open_.select("id", F.lit(field).alias("field"), value.alias("value"), F.lit(1).alias("seq"))
    changes = one("ttl", F.lit("permanent")).unionByName(one("label", F.col("label"))).unionByName(one("type", F.col("type"))).filter("value IS NOT NULL")
    return updated(nodes, changes, now)
