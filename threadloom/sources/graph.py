"""Graph tables: nodes and edges as DataFrames, and their projection from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NODE_COLUMNS = ("id", "label", "type", "status", "ttl", "project_id", "essence", "concepts", "created_at", "updated_at", "access_count", "quality", "work_status", "priority")
EDGE_COLUMNS = ("source_id", "target_id", "type", "status", "created_at", "valid_from", "valid_to")
TTLS = ("session", "1hr", "24hr", "1week", "project", "permanent")
ORDER_TYPES = ("task", "decision", "fact", "dead_end")
DOCUMENT_TYPES = ("fact", "insight", "decision", "constraint", "question", "preference")
#: The time that stands for now in every query, so that results don't depend on the day.
NOW = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _node(df: DataFrame, **given: Column) -> DataFrame:
    """Selects all node columns; those not given are null, or empty for concepts."""
    kinds = {"concepts": "array<string>", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz", "access_count": "bigint", "quality": "bigint"}
    columns = []
    for c in NODE_COLUMNS:
        value = given.get(c)
        if value is None:
            value = F.array() if c == "concepts" else F.lit(None)
        columns.append(value.cast(kinds.get(c, "string")).alias(c))
    return df.select(*columns)


@dataclass
class GraphStore:
    """The tables of one folder as a graph. Everything is lazy, and unused branches are pruned by their type filters."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def roots(self) -> DataFrame:
        """Projects: regions, and nations below them."""
        start = at("2020-01-01 00:00:00")
        region = _node(self.table("region"), id=F.concat(F.lit("r"), "r_regionkey"), label=F.lower("r_name"), type=F.lit("project"), status=F.lit("active"), ttl=F.lit("permanent"), essence=F.col("r_name"), created_at=start, updated_at=start, access_count=F.lit(0), quality=F.lit(3))
        nation = _node(self.table("nation"), id=F.concat(F.lit("n"), "n_nationkey"), label=F.lower("n_name"), type=F.lit("project"), status=F.lit("active"), ttl=F.lit("permanent"), project_id=F.concat(F.lit("r"), "n_regionkey"), essence=F.col("n_name"), created_at=start, updated_at=start, access_count=F.lit(0), quality=F.lit(3))
        return region.unionByName(nation)

    def entities(self) -> DataFrame:
        c, k = self.table("customer"), F.col("c_custkey")
        begun = at("2021-01-01 00:00:00")
        customer = _node(c, id=F.concat(F.lit("c"), k), label=F.lower("c_name"), type=F.lit("entity"), status=F.lit("active"), ttl=F.lit("project"), project_id=F.concat(F.lit("n"), "c_nationkey"), essence=F.col("c_name"), concepts=F.array(F.lower("c_mktsegment")), created_at=begun, updated_at=begun + F.make_dt_interval(days=(k % 1000).cast("int")), access_count=k % 7, quality=1 + k % 5)
        k = F.col("s_suppkey")
        supplier = _node(self.table("supplier"), id=F.concat(F.lit("s"), k), label=F.lower("s_name"), type=F.lit("entity"), status=F.lit("active"), ttl=F.lit("project"), project_id=F.concat(F.lit("n"), "s_nationkey"), essence=F.col("s_name"), created_at=begun, updated_at=begun, access_count=k % 7, quality=1 + k % 5)
        return customer.unionByName(supplier)

    def artifacts(self) -> DataFrame:
        k = F.col("p_partkey")
        made = at("2022-01-01 00:00:00") + F.make_dt_interval(days=(k % 365).cast("int"))
        concepts = F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"), F.lower("p_brand")))
        return _node(self.table("part"), id=F.concat(F.lit("p"), k), label=F.concat(F.lit("part_"), k), type=F.lit("artifact"), status=F.lit("created"), ttl=F.lit("1week"), essence=F.col("p_name"), concepts=concepts, created_at=made, updated_at=made, access_count=k % 11, quality=1 + k % 5)

    def work(self) -> DataFrame:
        """Orders as tasks, decisions, facts and dead ends of their customer's nation."""
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        k = F.col("o_orderkey")
        level = F.substring("o_orderpriority", 1, 1)
        return _node(
            o,
            id=F.concat(F.lit("o"), k),
            label=F.concat(F.lit("order_"), k),
            type=pick(ORDER_TYPES, k),
            status=F.when(k % 10 == 0, "archived").when(k % 10 == 1, "pending").otherwise("active"),
            ttl=pick(TTLS, k),
            project_id=F.concat(F.lit("n"), "c_nationkey"),
            essence=F.col("o_orderpriority"),
            concepts=F.array(F.lower("o_orderpriority")),
            created_at=F.col("o_orderdate"),
            updated_at=F.col("o_orderdate") + F.make_dt_interval(days=(k % 200).cast("int")),
            access_count=k % 5,
            quality=1 + k % 5,
            work_status=F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done"),
            priority=F.when(level.isin("1", "2"), "high").when(level == "3", "medium").otherwise("low"),
        )

    def notes(self) -> DataFrame:
        """Documents as facts, insights, decisions, constraints, questions and preferences of their source."""
        k = F.col("doc_id")
        seen = at("2024-01-01 00:00:00") + F.make_dt_interval(mins=k.cast("int"))
        return _node(self.table("documents"), id=F.concat(F.lit("d"), k), label=F.concat(F.lit("doc_"), k), type=pick(DOCUMENT_TYPES, k), status=F.lit("active"), ttl=pick(TTLS, k), project_id=F.col("source"), essence=F.col("text"), concepts=F.array("lang"), created_at=seen, updated_at=seen, access_count=k % 5, quality=1 + k % 5)

    def nodes(self) -> DataFrame:
        """All nodes but the documents' texts, which notes() has."""
        return reduce(DataFrame.unionByName, (self.roots(), self.entities(), self.artifacts(), self.work()))

    def containment(self) -> DataFrame:
        """part_of edges: nation to region, customer and supplier to nation, order to customer."""
        pairs = [("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")]
        start = at("2020-01-01 00:00:00")
        return reduce(DataFrame.unionByName, (_edge(self.table(t).select(F.concat(F.lit(a), x).alias("source_id"), F.concat(F.lit(b), y).alias("target_id")), "part_of", start) for t, a, x, b, y in pairs))

    def prompts(self) -> DataFrame:
        """prompted_by edges: each order from the one before of the same customer."""
        before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        o = self.table("orders").withColumn("cause", before).filter("cause IS NOT NULL")
        return _edge(o.select(F.concat(F.lit("o"), "o_orderkey").alias("source_id"), F.concat(F.lit("o"), "cause").alias("target_id"), "o_orderdate"), "prompted_by", F.col("o_orderdate"))

    def evidence(self) -> DataFrame:
        """based_on edges: an order from the first one of the same customer with the same part, if that is another."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey").join(self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        # an order is one row with its parts when it is sent to its customer; a struct keeps null parts
        bought = lines.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.collect_set(F.struct("l_partkey")).alias("parts"))
        bought = bought.repartition("o_custkey").select("o_orderkey", "o_custkey", "o_orderdate", F.explode("parts.l_partkey").alias("l_partkey"))
        w = Window.partitionBy("o_custkey", "l_partkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        pairs = bought.withColumn("cause", F.first("o_orderkey").over(w)).filter("cause <> o_orderkey")
        pairs = pairs.select("o_orderkey", "cause", "o_orderdate").distinct()
        return _edge(pairs.select(F.concat(F.lit("o"), "o_orderkey").alias("source_id"), F.concat(F.lit("o"), "cause").alias("target_id"), "o_orderdate"), "based_on", F.col("o_orderdate"))

    def supplies(self) -> DataFrame:
        """Edges from orders to suppliers, one a lineitem: depends_on, affects or contradicts by return flag."""
        kind = F.when(F.col("l_returnflag") == "N", "depends_on").when(F.col("l_returnflag") == "A", "affects").otherwise("contradicts")
        ended = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 5), F.col("l_shipdate") + F.make_dt_interval(days=F.lit(30)))
        li = self.table("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), kind.alias("kind"), "l_shipdate", ended.alias("ended"))
        return _edge(li, F.col("kind"), F.col("l_shipdate"), F.col("ended"))

    def revisions(self) -> DataFrame:
        """supersedes edges: a document from the one before with the same text up to case and white space."""
        text = normal_text(F.col("text"))
        before = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
        d = self.table("documents").select("doc_id", F.md5(text).alias("h")).withColumn("cause", before).filter("cause IS NOT NULL")
        return _edge(d.select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.concat(F.lit("d"), "cause").alias("target_id")), "supersedes", at("2024-01-01 00:00:00"))

    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.containment(), self.prompts(), self.evidence(), self.supplies()))


def normal_text(text: Column) -> Column:
    """Lower case (A-Z), with runs of white space as one space and none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\r\n]+", " "))


def _edge(df: DataFrame, kind: str | Column, begun: Column, ended: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("source_id", "target_id", kind.alias("type"), F.lit("active").alias("status"), begun.alias("created_at"), begun.alias("valid_from"), (F.lit(None) if ended is None else ended).cast("timestamp_ntz").alias("valid_to"))


def live(nodes: DataFrame) -> DataFrame:
    return nodes.filter("status <> 'archived'")


def current(edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Edges that hold: no end of validity, and active. With as_of, those that held then."""
    held = F.col("valid_to").isNull() if as_of is None else (F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    return edges.filter(held & F.coalesce(F.col("status") == "active", F.lit(True)))
