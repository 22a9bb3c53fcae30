"""Writes on stored tables: what the tables hold after batches derived from the driver's tables, with the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stores as S
from ..sources.checkpoints import folder
from ..sources.graph import GraphStore, _node, now
from .prelude import EDGES, NODES, sql

QUERIES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(GraphStore(spark, sf_dir)), oracle)
        return f

    return add


NOW = "TIMESTAMP '2024-02-01'"


def tables(g: GraphStore) -> S.GraphTables:
    """Orders and their spine edges, stored."""
    return S.stored_graph(g.spark, folder(g.spark), g.work(), g.prompts().unionByName(g.evidence()), 16)


def notices(g: GraphStore) -> DataFrame:
    """A new node a customer: some labels are those of orders, in capitals, some come twice."""
    c = g.table("customer")
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ORDER_"), F.col("c_custkey") * 7)).otherwise(F.concat(F.lit("notice_"), F.floor(F.col("c_custkey") / 2)))
    return _node(c, id=F.concat(F.lit("m"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), label=label, type=F.lit("fact"), status=F.lit("active"), ttl=F.lit("project"), essence=F.col("c_name"), concepts=F.array(F.lower("c_mktsegment")), created_at=now(), updated_at=now(), access_count=F.lit(0), quality=F.lit(2))


_NOTICES = f"""
raw AS (SELECT 'm' || lpad(c_custkey::VARCHAR, 9, '0') AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ORDER_' || c_custkey * 7 ELSE 'notice_' || floor(c_custkey / 2)::BIGINT END AS label, c_name AS essence FROM customer),
fresh AS (SELECT lower(label) AS k, min(id) AS id, arg_min(label, id) AS label, arg_min(essence, id) AS essence FROM raw GROUP BY 1),
work AS (SELECT * FROM nodes WHERE id LIKE 'o%'),
created AS (SELECT w.id, w.label, CASE WHEN back THEN 'active' ELSE w.status END AS status, CASE WHEN back THEN 'project' ELSE w.ttl END AS ttl, CASE WHEN back THEN f.essence ELSE w.essence END AS essence, CASE WHEN back THEN {NOW} ELSE w.updated_at END AS updated_at
  FROM (SELECT w.*, status = 'archived' AND lower(label) IN (SELECT k FROM fresh) AS back FROM work w) w LEFT JOIN fresh f ON f.k = lower(w.label)
  UNION ALL SELECT id, label, 'active', 'project', essence, {NOW} FROM fresh WHERE k NOT IN (SELECT lower(label) FROM work))"""


@query("w01_created", sql("SELECT * FROM created", NODES, ctes=_NOTICES))
def created(g: GraphStore) -> DataFrame:
    """Orders after a batch of new nodes, which is sent twice."""
    t = tables(g)
    for _ in range(2):
        S.create(t, notices(g), now(), "notices")
    return t.nodes().select("id", "label", "status", "ttl", "essence", "updated_at")


def corrections(g: GraphStore) -> DataFrame:
    """Changes of orders, one or more a field, from the lines of small quantities."""
    li = g.table("lineitem").filter("l_quantity < 4")
    one = lambda field, value: li.select(F.concat(F.lit("o"), "l_orderkey").alias("id"), F.lit(field).alias("field"), value.alias("value"), F.col("l_linenumber").alias("seq"))
    return one("priority", F.col("l_returnflag")).unionByName(one("quality", (F.col("l_linenumber") % 6).cast("string")))


_CORRECTIONS = """
sent AS (SELECT 'o' || l_orderkey AS id, 'priority' AS field, l_returnflag AS value, l_linenumber AS seq FROM lineitem WHERE l_quantity < 4 UNION ALL SELECT 'o' || l_orderkey, 'quality', (l_linenumber % 6)::VARCHAR, l_linenumber FROM lineitem WHERE l_quantity < 4),
last AS (SELECT id, field, arg_max(value, (seq, value)) AS value FROM sent GROUP BY 1, 2),
work AS (SELECT * FROM nodes WHERE id LIKE 'o%')"""


@query("w02_updated", sql(f"SELECT w.id, coalesce(p.value, w.priority) AS priority, coalesce(q.value::BIGINT, w.quality) AS quality, CASE WHEN p.id IS NULL THEN w.updated_at ELSE {NOW} END AS updated_at FROM work w LEFT JOIN last p ON p.id = w.id AND p.field = 'priority' LEFT JOIN last q ON q.id = w.id AND q.field = 'quality'", NODES, ctes=_CORRECTIONS))
def updated(g: GraphStore) -> DataFrame:
    t = tables(g)
    S.update(t, corrections(g), now(), "corrections")
    return t.nodes().select("id", "priority", "quality", "updated_at")


@query("w02_history", sql(f"SELECT l.id, field, CASE field WHEN 'priority' THEN w.priority ELSE w.quality::VARCHAR END AS old_value, value AS new_value FROM last l JOIN work w ON w.id = l.id WHERE CASE field WHEN 'priority' THEN w.priority ELSE w.quality::VARCHAR END IS DISTINCT FROM value", NODES, ctes=_CORRECTIONS))
def history(g: GraphStore) -> DataFrame:
    return S.update(tables(g), corrections(g), now())[1].select("id", "field", "old_value", "new_value")


def readings(g: GraphStore) -> DataFrame:
    """Edges from orders to the one three before in number: some hold already, some have no end."""
    o = g.table("orders").filter("o_orderkey % 5 < 2")
    key = F.col("o_orderkey")
    return o.select(F.concat(F.lit("o"), key).alias("source_id"), F.concat(F.lit("o"), F.when(key % 7 == 0, key + 10_000_000).otherwise(key - 3)).alias("target_id"), F.lit("extends").alias("type"), F.lit("active").alias("status"), now().alias("created_at"), now().alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))


_LINKED = f"""
spine_e AS (SELECT source_id, target_id, type, valid_to FROM prompts UNION ALL SELECT source_id, target_id, type, valid_to FROM evidence),
new_e AS (SELECT 'o' || o_orderkey AS source_id, 'o' || (o_orderkey - 3) AS target_id FROM orders WHERE o_orderkey % 5 < 2 AND o_orderkey % 7 <> 0 AND o_orderkey - 3 IN (SELECT o_orderkey FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer)),
out_n AS (SELECT source_id AS id FROM spine_e UNION SELECT source_id FROM new_e)"""


@query(
    "w03_linked",
    sql("SELECT source_id, target_id, type FROM spine_e UNION ALL SELECT DISTINCT source_id, target_id, 'extends' FROM new_e", NODES, EDGES, ctes=_LINKED),
)
def linked(g: GraphStore) -> DataFrame:
    """Spine edges after a batch of edges that is sent twice, of which only those with both ends are taken."""
    t = tables(g)
    for batch in (None, None):
        S.link(t, readings(g), batch)
    return t.edges().select("source_id", "target_id", "type")


@query("w03_requalified", sql("SELECT id, CASE WHEN quality < 5 AND id IN (SELECT source_id FROM new_e) THEN 1 + (len(concepts) >= 3)::BIGINT + (id IN (SELECT id FROM out_n))::BIGINT ELSE quality END AS quality FROM nodes WHERE id LIKE 'o%'", NODES, EDGES, ctes=_LINKED))
def requalified(g: GraphStore) -> DataFrame:
    """Orders' quality after those edges: counted anew for their sources."""
    t = tables(g)
    S.link(t, readings(g), "readings")
    return t.nodes().select("id", "quality")


@query("w04_ended", sql(f"SELECT source_id, target_id, type, CASE WHEN type = 'prompted_by' AND substr(source_id, 2)::BIGINT % 10 = 0 THEN {NOW} ELSE valid_to END AS valid_to FROM spine_e", EDGES, ctes=_LINKED.split(",\nnew_e")[0]))
def ended(g: GraphStore) -> DataFrame:
    """Spine edges after the causes of archived orders have ended."""
    t = tables(g)
    S.end(t, g.prompts().filter(F.substring("source_id", 2, 20).cast("bigint") % 10 == 0), now(), "ended")
    return t.edges().select("source_id", "target_id", "type", "valid_to")


@query(
    "w05_forgotten",
    sql(f"SELECT id AS source_id, status AS type, NULL::TIMESTAMP AS valid_to FROM (SELECT id, CASE WHEN substr(id, 2)::BIGINT % 11 = 0 THEN 'archived' ELSE status END AS status FROM nodes WHERE id LIKE 'o%') UNION ALL SELECT source_id, type, CASE WHEN substr(source_id, 2)::BIGINT % 11 = 0 THEN {NOW} ELSE valid_to END FROM spine_e", NODES, EDGES, ctes=_LINKED.split(",\nnew_e")[0]),
)
def forgotten(g: GraphStore) -> DataFrame:
    """Orders and spine edges, end to end, after every eleventh order was forgotten."""
    t = tables(g)
    S.forget(t, g.work().filter(F.substring("id", 2, 20).cast("bigint") % 11 == 0), now(), "forgotten")
    nodes = t.nodes().select(F.col("id").alias("source_id"), F.col("status").alias("type"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return nodes.unionByName(t.edges().select("source_id", "type", "valid_to"))


@query(
    "w05_remembered",
    sql(
        "SELECT source_id, target_id, type FROM spine_e UNION SELECT a.id, b.id, 'supports' FROM ties JOIN fin a ON lower(a.label) = lower(source_label) JOIN fin b ON lower(b.label) = lower(target_label)",
        NODES,
        EDGES,
        ctes=_LINKED.split(",\nnew_e")[0]
        + ","
        + _NOTICES
        + ", fin AS (SELECT id, label FROM created), ties AS (SELECT label AS source_label, 'Order_' || (substr(id, 2)::BIGINT + 1) AS target_label FROM raw)",
    ),
)
def remembered(g: GraphStore) -> DataFrame:
    """Edges after the new nodes were remembered with a tie each, some to labels that nobody has."""
    t = tables(g)
    new = notices(g)
    ties = new.select(F.col("label").alias("source_label"), F.concat(F.lit("Order_"), F.substring("id", 2, 20).cast("bigint") + 1).alias("target_label"), F.lit("supports").alias("type"))
    for _ in range(2):
        S.remember(t, new, ties, now(), "memo")
    return t.edges().select("source_id", "target_id", "type").distinct()
