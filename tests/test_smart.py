from __future__ import annotations

import datetime

from threadloom.operators import smart

NODES = "id string, label string, type string, essence string, payload map<string,string>, concepts array<string>, project_id string, quality bigint"
NOON = datetime.datetime(2024, 1, 1, 12)


def node(k, essence, vector=False, kind="fact", quality=3):
    return (f"{'p' if vector else 'o'}{k:03}", "x", kind, essence, {"state": "red"}, ["bolt"], "n1", quality)


def test_alike_nodes_are_one_kind_and_vectors_count(spark):
    rows = [node(k, "red bolt") for k in range(200)] + [node(k, "red bolt", True) for k in range(4)] + [node(9, "nothing", True), node(7, "red bolts", kind="dead_end")]
    nodes = spark.createDataFrame(rows, NODES)
    marked, kinds = smart.profiled(nodes, spark.createDataFrame([("red",), ("bolt",)], "stem string"))
    # p009 meets words by its value and concept only
    assert kinds.count() == 2 and marked.groupBy("kind").count().orderBy("count").select("count").collect() == [(1,), (205,)]
    queries = spark.createDataFrame([(1, "red bolt", 5, NOON, [1.0, 0.0]), (2, "find unknown", 6, NOON, [0.0, 1.0]), (3, "why red", 6, NOON, None)], "query_id bigint, text string, agent int, asked_at timestamp, embedding array<double>")
    accesses = spark.createDataFrame([(5, NOON, "n1")], "agent int, at timestamp, project string")
    vectors = spark.createDataFrame([("p000", [1.0, 0.0]), ("p001", [-1.0, 0.0]), ("p002", [0.0, 0.0]), ("p003", [1.0, 0.0, 0.0]), ("p009", [0.0, 2.0])], "id string, v array<double>")
    got = {}
    for r in smart.recall_smart(nodes, queries, accesses, vectors, 6).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r)
    # a vector that cannot be compared is none, so p002 and p003 come behind o000 to o199 by id only
    assert [r.id for r in got[1]] == ["p000", "o000", "o001", "o002", "o003", "o004"]
    # essence, value and concept of one word each or both, and the project
    assert got[1][1].ticks == 5 and got[1][1].why == "essence[bolt, red] | value[red] | concept[bolt] | context[n1]"
    assert got[1][0].score == round((6.0 / 20 * 0.6 + 0.4) * 0.875, 6) and got[1][1].score == round(6.0 / 20 * 0.6 * 0.875, 6)
    assert [(r.id, r.why) for r in got[2]] == [("p009", "semantic[100%]")]
    assert [r.id for r in got[3]][:2] == ["o007", "o000"] and got[3][0].score == round(2.5 / 20 * 0.6 * 0.875 * 1.5, 6)
