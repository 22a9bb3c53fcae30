"""Writes as the next snapshot: plain tables have no MERGE, so a change is a new table or an appended log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields of a node that may change.
UPDATABLE = (
    "label", "type", "status", "ttl", "project_id", "essence", "content", "source", "concepts", "aliases", "embedding", "locked", "enriched_at",
    "quality_score", "last_challenged_at", "priority", "flow_role", "chain_id", "review_status", "review_reason", "source_excerpt",
)
#: The columns here that stand for quality_score and for parts of content.
OWN = ("quality", "work_status", "payload")


def created(nodes: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """nodes with new ones: a label that exists keeps its id, in any case of letters.

    An archived node of that label becomes active, with the new essence and ttl where there are any; another takes in the
    new payload's keys, if nodes have a payload. New labels that come several times are created once, with the smallest id.
    """
    key = F.lower("label")
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter("__n = 1").drop("__n")
    added = first.join(nodes.select(key.alias("__k")), F.lower(first["label"]) == F.col("__k"), "left_anti")
    return brought_back(nodes, first, now).unionByName(added)


def brought_back(nodes: DataFrame, first: DataFrame, now: Column) -> DataFrame:
    """nodes, of which those with the label of a row of first take in what created() says; first has each label once."""
    key = F.lower("label")
    merges = "payload" in nodes.columns
    again = first.select(key.alias("__k"), F.lit(True).alias("__again"), F.nullif("essence", F.lit("")).alias("__essence"), F.col("ttl").alias("__ttl"), *([F.col("payload").alias("__payload")] if merges else []))
    held = nodes.withColumn("__k", key).join(again, "__k", "left")
    back = F.col("__again") & (F.col("status") == "archived")
    changes = {"essence": F.when(back, F.coalesce("__essence", "essence")).otherwise(F.col("essence")), "ttl": F.when(back, F.coalesce("__ttl", "ttl")).otherwise(F.col("ttl")), "status": F.when(back, "active").otherwise(F.col("status"))}
    touched = back
    if merges:
        live = F.col("__again") & (F.col("status") != "archived") & F.col("__payload").isNotNull()
        empty = F.create_map().cast("map<string,string>")
        old = F.map_filter(F.coalesce("payload", empty), lambda k, _: ~F.map_contains_key("__payload", k))
        changes["payload"] = F.when(live, F.map_concat(old, "__payload")).otherwise(F.col("payload"))
        touched = back | live
    changes["updated_at"] = F.when(touched, now).otherwise(F.col("updated_at"))
    return held.withColumns(changes).select(*nodes.columns)


def updated(nodes: DataFrame, changes: DataFrame, now: Column, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Next nodes and the history of changes (id, field, value as text); fields that may not change raise.

    Of several changes of a field the last by seq holds. Where nodes have a column locked, changes of a locked node
    raise unless forced or one of them is of locked itself; a batch that raises changes nothing.
    """
    fields = [r.field for r in changes.select("field").distinct().collect()]
    if bad := sorted(set(fields) - (set(UPDATABLE + OWN) & set(nodes.columns))):
        raise ValueError(f"fields that can't be updated: {', '.join(bad)}")
    if "locked" in nodes.columns and not force:
        asked = changes.groupBy("id").agg(F.bool_or(F.col("field") == "locked").alias("opens")).filter("NOT opens")
        if held := nodes.filter("locked").join(asked, "id", "left_semi").select("label").head():
            raise PermissionError(f"{held.label} is locked")
    last = changes.groupBy("id", "field").agg(F.max(F.struct("seq", "value"))["value"].alias("value"))
    wide = last.groupBy("id").agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"__{f}") for f in fields))
    joined = nodes.join(wide, "id", "left")
    kinds = dict(nodes.dtypes)
    values = {f: F.from_json(F.col(f"__{f}.value"), kinds[f]) if kinds[f].startswith("array") else F.col(f"__{f}.value").cast(kinds[f]) for f in fields}
    touched = reduce(lambda a, b: a | b, (F.col(f"__{f}").isNotNull() for f in fields), F.lit(False))
    after = joined.withColumns({f: F.when(F.col(f"__{f}").isNotNull(), v).otherwise(F.col(f)) for f, v in values.items()} | {"updated_at": F.when(touched, now).otherwise(F.col("updated_at"))}).select(*nodes.columns)
    old = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string") if not kinds[f].startswith("array") else F.to_json(f)))) if fields else F.lit(None)
    history = last.join(nodes.withColumn("__old", old).select("id", "__old"), "id").select("id", "field", F.col("__old")[F.col("field")].alias("old_value"), F.col("value").alias("new_value"), now.alias("changed_at"))
    return after, history.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def linked(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with new ones whose ends exist; an edge that holds already is not added again."""
    ids = nodes.select("id")
    known = new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    held = edges.filter("valid_to IS NULL").select("source_id", "target_id", "type")
    return edges.unionByName(known.dropDuplicates(["source_id", "target_id", "type"]).join(held, ["source_id", "target_id", "type"], "left_anti").select(*edges.columns))


def ended(edges: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """edges after those named (source_id, target_id, type) have ended; history stays."""
    marked = edges.join(gone.select("source_id", "target_id", "type").distinct().withColumn("__gone", F.lit(True)), ["source_id", "target_id", "type"], "left")
    return marked.withColumn("valid_to", F.when(F.col("__gone") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).select(*edges.columns)


def decided(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """edges after decisions (source_id, target_id, type, decision, new_type), one an edge.

    approve makes a pending edge active and reject takes it away; neither touches others. retype changes the type of any edge.
    """
    key = ["source_id", "target_id", "type"]
    e = edges.join(decisions.select(*key, "decision", "new_type").dropDuplicates(key), key, "left")
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    e = e.filter(~(pending & F.coalesce(F.col("decision") == "reject", F.lit(False))))
    status = F.when(pending & (F.col("decision") == "approve"), "active").otherwise(F.col("status"))
    kind = F.when((F.col("decision") == "retype") & F.col("new_type").isNotNull(), F.col("new_type")).otherwise(F.col("type"))
    return e.withColumns({"status": status, "type": kind}).select(*edges.columns)


def archived(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes marked archived and their outgoing edges ended; incoming ones stay."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    after = nodes.join(gone, "id", "left").withColumn("status", F.when(F.col("__gone"), "archived").otherwise(F.col("status"))).select(*nodes.columns)
    closing = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return after, ended(edges, closing, now)


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The current rows of an append-only log: the last of each key."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def status_steps(log: DataFrame, steps: tuple[str, ...] = ("captured", "pass01_done", "extracted")) -> DataFrame:
    """Each transition of a turn's status (key, seq, status) and whether it is a legal one: to the next step only."""
    place = F.array_position(F.array(*map(F.lit, steps)), F.col("status"))
    before = F.coalesce(F.lag(place).over(Window.partitionBy("key").orderBy("seq")), F.lit(0))
    return log.withColumn("legal", place == before + 1)


def snapshot(df: DataFrame, folder: str, name: str, keep: int = 5) -> list[str]:
    """Writes df as a snapshot folder and drops all but the newest keep; returns those left, by name."""
    spark = df.sparkSession
    df.write.parquet(f"{folder}/{name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True)
    for old in names[keep:]:
        fs.delete(hadoop.Path(f"{folder}/{old}"), True)
    return names[:keep]
