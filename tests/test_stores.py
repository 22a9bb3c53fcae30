from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators import nearby, stores
from threadloom.operators.composites import tags_of
from threadloom.operators.nearby import graph_slices, neighbourhoods, quotas
from threadloom.operators import cells
from threadloom.sources.versions import BucketedTable

NODE = "id string, label string, type string, status string, ttl string, essence string, concepts array<string>, quality bigint, updated_at timestamp_ntz, payload map<string,string>"
EDGE = "source_id string, target_id string, type string, status string, created_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz"


def node(i, label, status="active", **more):
    return (i, label, "fact", status, "project", more.get("essence"), more.get("concepts", []), more.get("quality", 1), None, more.get("payload"))


@pytest.fixture
def graph(spark, tmp_path):
    nodes = spark.createDataFrame([node(f"n{k}", f"Label_{k}", "archived" if k % 4 == 0 else "active", payload={"a": "1"}) for k in range(40)], NODE)
    edges = spark.createDataFrame([(f"n{k}", f"n{k - 1}", "extends", "active", None, None, None) for k in range(1, 40)], EDGE)
    return stores.stored_graph(spark, f"file://{tmp_path}/g", nodes, edges, 8), tmp_path


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_only_touched_buckets_are_written(spark, graph):
    g, path = graph
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    before = files(f"{path}/g/nodes/data")
    new = spark.createDataFrame([node("x1", "label_8", essence="back"), node("x2", "fresh"), node("x3", "FRESH"), node("x4", "label_9", payload={"b": "2"})], NODE)
    assert stores.create(g, new, now, "one") == 2
    got = {r.id: r for r in g.nodes().collect()}
    assert set(got) == {f"n{k}" for k in range(40)} | {"x2"}
    assert (got["n8"].status, got["n8"].essence, got["n9"].payload, got["n10"].payload) == ("active", "back", {"a": "1", "b": "2"}, {"a": "1"})
    after = files(f"{path}/g/nodes/data")
    made = g.nodes_table.made(2)
    assert before.items() <= after.items() and 0 < sum(m == 2 for m in made.values()) <= 3 and len(after) - len(before) == sum(m == 2 for m in made.values())
    # the same batch again, then the version before
    assert stores.create(g, new, now, "one") == 2 and files(f"{path}/g/nodes/data") == after
    assert {r.id: r.status for r in g.nodes(1).collect()}["n8"] == "archived" and g.nodes(1).count() == 40


def test_a_write_that_stopped_leaves_the_table_as_it_was(spark, graph, monkeypatch):
    g, path = graph
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    changes = spark.createDataFrame([("n3", "essence", "half", 1)], "id string, field string, value string, seq int")
    os.makedirs(f"{path}/g/nodes/data/made=2/bucket=0")
    os.makedirs(f"{path}/g/nodes/versions/2")
    assert g.nodes_table.latest() == 1 and g.nodes().count() == 40
    version, history = stores.update(g, changes, now)
    assert version == 2 and [tuple(r)[:4] for r in history.collect()] == [("n3", "essence", None, "half")]
    assert {r.id: r.essence for r in g.nodes().collect()} == {f"n{k}": "half" if k == 3 else None for k in range(40)}


def test_edges_end_and_link_by_bucket(spark, graph):
    g, _ = graph
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    new = spark.createDataFrame([("n1", "n0", "extends", "active", None, None, None), ("n1", "n30", "supports", "active", None, None, None), ("n1", "n30", "supports", "active", None, None, None), ("n1", "gone", "supports", "active", None, None, None)], EDGE)
    stores.link(g, new)
    stores.link(g, new)
    assert g.edges().count() == 40 and g.edges().filter("type = 'supports'").count() == 1
    assert {r.id: r.quality for r in g.nodes().collect()}["n1"] == 2
    stores.forget(g, spark.createDataFrame([("n1",), ("n5",), ("n5",)], "id string"), now)
    assert {r.id for r in g.nodes().filter("status = 'archived'").collect()} == {f"n{k}" for k in range(0, 40, 4)} | {"n1", "n5"}
    assert sorted((r.source_id, r.target_id) for r in g.edges().filter("valid_to IS NOT NULL").collect()) == [("n1", "n0"), ("n1", "n30"), ("n5", "n4")]


def test_an_empty_table_takes_rows(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", "id", 4)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    assert t.create(rows.limit(0)) == 1 and t.read(rows.schema).count() == 0
    t.rewrite(rows.schema, rows, lambda old: old.unionByName(rows))
    assert sorted(map(tuple, t.read(rows.schema).collect())) == [("a", 1), ("b", 2)] and t.rewrite(rows.schema, rows.limit(0), lambda old: old) == 2


def test_tags_leave_out_words_that_say_nothing(spark):
    got = spark.range(1).select(tags_of(F.lit("Which of these caches, without their timeouts, would every shard need? caches"))).head()[0]
    assert got == ["caches", "timeouts", "shard"]


def test_slices_and_quotas(spark):
    n = lambda i, label, essence, concepts=(), root=None, day=1: (i, label, essence, list(concepts), root, f"2024-01-{day:02}")
    rows = [
        n("a", "p_fact_x", "Red  Widget.", ["paint"], "p", 1), n("b", "p_fact_y", "red widget", [], "p", 2), n("c", "unspecified-project_fact_z", "red bolt", [], "q", 3),
        n("d", "m_fact_z", "'red widget'", [], None, 4), n("e", "q_fact_k", None, ["painting"], "q", 5), n("f", "q_fact_l", "of it", [], "gone", 6), n("g", "x_y", "blue", [], "r", 7),
    ]
    nodes = spark.createDataFrame(rows, "id string, label string, essence string, concepts array<string>, project_id string, day string").withColumn("updated_at", F.col("day").cast("timestamp_ntz"))
    roots = spark.createDataFrame([("p", "p", "one"), ("q", "q", "two"), ("r", "r", "three"), ("m", "m", "Miscellaneous things")], "id string, label string, essence string")
    ask = nodes.filter("id = 'a'").select(F.col("id").alias("query_id"), F.col("essence").alias("value"), "concepts")
    got = [(r.id, round(r.identity, 4), r.catch_all) for r in graph_slices(nodes, ask, 3, roots).orderBy("place").collect()]
    assert got == [("b", 1.0, False), ("d", 1.0, True), ("c", 0.1667, True)]
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "e", [1.0, 0.1]), (3, "c", [-1.0, 0.0]), (4, "g", [1.0, 0.0])], "vec_id bigint, id string, v array<double>")
    got = [(r.id, round(r.rank, 3)) for r in graph_slices(nodes, ask, 5, roots, vectors.select("id", "v")).orderBy("place").collect()]
    # painting holds paint, so e comes in by its cosine; c falls to 1/6 - 0.2; blue shares nothing
    assert got == [("b", 1.0), ("d", 1.0), ("e", 0.199)]
    index = cells.indexed(vectors.withColumnRenamed("v", "embedding"), 2)
    related = spark.createDataFrame([("p", "q")], "root_a string, root_b string")
    anchors = nodes.filter("id IN ('a', 'f')")
    got = {(r.anchor, r.id, r.tier, r.place) for r in neighbourhoods(anchors, nodes, roots, related, vectors, index, cap=6, near=2).collect()}
    # f's project is unknown, but its label begins with q, and q is related to p; of a's vector g and e are near
    assert got == {("a", "f", "member", 1), ("a", "e", "member", 2), ("a", "c", "member", 3), ("a", "b", "member", 4), ("a", "d", "net", 5), ("a", "g", "near", 1)} | {("f", "e", "member", 1), ("f", "c", "member", 2), ("f", "b", "member", 3), ("f", "a", "member", 4)}
    one = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "anchor string, id string, place bigint")
    two = spark.createDataFrame([("a", "x", 1), ("a", "z", 2), ("b", "w", 1)], "anchor string, id string, place bigint")
    assert sorted(tuple(r) for r in quotas([("first", one), ("second", two)], 3).collect()) == [("a", "x", "first", 1), ("a", "y", "first", 2), ("a", "z", "second", 3), ("b", "w", "second", 2), ("b", "x", "first", 1)]


def test_what_is_sent_again_is_neither_worked_out_nor_written(spark, graph, monkeypatch):
    g, path = graph
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    new = spark.createDataFrame([node("x1", "label_8", essence="back"), node("x2", "fresh")], NODE)
    ties = spark.createDataFrame([("fresh", "Label_3", "supports"), ("LABEL_5", "nobody", "supports")], "source_label string, target_label string, type string")
    versions = stores.remember(g, new, ties, now, "memo")
    assert sorted((r.source_id, r.target_id) for r in g.edges().filter("type = 'supports'").collect()) == [("x2", "n3")]
    settled = stores.settled
    monkeypatch.setattr(stores, "settled", None)
    assert stores.remember(g, new, ties, now, "memo") == versions
    monkeypatch.setattr(stores, "settled", settled)
    # without a name the edges are looked at, but no bucket is made anew
    again = spark.createDataFrame([("n1", "n0", "extends", "active", None, None, None), ("n7", "n2", "extends", "active", None, None, None)], EDGE)
    stores.link(g, again)
    before = files(f"{path}/g")
    assert stores.link(g, again) == g.edges_table.latest() and files(f"{path}/g") == before
    # a named batch in which nothing is new is taken in, so that it stays without effect after its edges have ended
    stores.link(g, again, "late")
    stores.end(g, again, now)
    stores.link(g, again, "late")
    assert g.edges().filter("valid_to IS NULL AND source_id = 'n7' AND target_id = 'n2'").count() == 0 and g.edges().count() == 41


def test_slices_rank_no_more_nodes_without_a_vector_than_may_come_in(spark, monkeypatch):
    seen = []
    settled = nearby.settled
    monkeypatch.setattr(nearby, "settled", lambda df: seen.append(settled(df)) or seen[-1])
    rows = [(f"n{k:03}", f"p_{k}", "red widget" if k % 2 else "red bolt", ["paint"]) for k in range(400)]
    nodes = spark.createDataFrame(rows, "id string, label string, essence string, concepts array<string>")
    vectors = spark.createDataFrame([("n001", [1.0, 0.0]), ("n301", [1.0, 0.1]), ("n303", [-1.0, 0.0])], "id string, v array<double>")
    roots = spark.createDataFrame([], "id string, label string, essence string")
    ask = nodes.filter("id IN ('n001', 'n005')").select(F.col("id").alias("query_id"), F.col("essence").alias("value"), "concepts")
    got = graph_slices(nodes, ask, 3, roots, vectors).orderBy("query_id", "place").collect()
    # those with a vector are all met, of the others of a value no more than may be among the best; without a vector of its own a query goes by id
    assert [(r.query_id, r.id) for r in got] == [("n001", "n301"), ("n001", "n003"), ("n001", "n005"), ("n005", "n001"), ("n005", "n003"), ("n005", "n007")]
    assert seen[0].count() <= 2 * (2 * 4 + 3)


def test_quality_counts_an_older_edge_where_the_new_one_has_an_end(spark, graph):
    g, _ = graph
    past = "2023-01-01 00:00:00"
    new = spark.createDataFrame([("n1", "n5", "supports", "active", None, None, past), ("n0", "n5", "supports", "active", None, None, past)], "source_id string, target_id string, type string, status string, created_at string, valid_from string, valid_to string")
    stores.link(g, new.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in ("created_at", "valid_from", "valid_to") else c for c in new.columns)))
    got = {r.id: r.quality for r in g.nodes().collect()}
    assert (got["n1"], got["n0"]) == (2, 1) and g.edges().count() == 41
