"""Duplicate audits against all pairs, and recall within its budget."""

from __future__ import annotations

from itertools import combinations

from threadloom.operators import autorecall as R
from threadloom.operators import twins as T

EDGE = "source_id string, target_id string, type string, status string, valid_to timestamp_ntz"
BLOCK = "id string, scope string, type string, value string, concepts array<string>"
NODE = "id string, label string, type string, essence string, concepts array<string>, project_id string, quality bigint"


def words(text):
    out = "".join(c if c.isalnum() and c.isascii() else " " for c in (text or "").lower()).split()
    return {w for w in out if len(w) >= 4 and w not in T.COMMON}


def test_block_duplicates_equal_all_pairs(spark):
    names = ["alpha beta gamma", "alpha beta gamma delta", "Alpha  Beta Gamma", "beta gamma delta", "", None, "with this that", "alpha"]
    rows = [(f"b{i}", ("x", "y", None)[i % 3], ("fact", "insight")[i // 3 % 2], names[i % len(names)], [f"c{i % 2}", None] if i % 5 else None) for i in range(60)]
    edges = spark.createDataFrame([("b0", "b24", "supersedes", "active", None), ("b30", "b6", "supersedes", "active", None), ("b0", "b48", "supersedes", "ended", None)], EDGE)
    tied = {("b0", "b24"), ("b30", "b6")}
    plain = {r[0]: " ".join((r[3] or "").lower().split()) for r in rows}
    want = {"primary_value_exact": 0, "primary_value_overlap": 0}
    fresh = dict(want)
    new = {"b0", "b7", "b9", "b30"}
    for a, b in combinations(rows, 2):
        if a[1] is None or a[1] != b[1] or tuple(sorted((a[0], b[0]))) in tied:
            continue
        signal = None
        if plain[a[0]] and plain[a[0]] == plain[b[0]]:
            signal = "primary_value_exact"
        elif a[2] == b[2] and len(words(a[3]) & words(b[3])) >= 3:
            signal = "primary_value_overlap"
        if signal:
            want[signal] += 1
            fresh[signal] += bool(new & {a[0], b[0]})
    blocks = spark.createDataFrame(rows, BLOCK)
    found = T.block_duplicates(blocks, edges).groupBy("signal").sum("links").collect()
    assert {r[0]: r[1] for r in found} == want and all(want.values()) and all(fresh.values())
    similar = spark.createDataFrame([("b0", "b3", 0.9), ("b0", "b9", 0.79), ("b7", "b8", 0.99), ("b3", "b15", 0.99)], "query_id string, id string, similarity double")
    inline = T.inline_duplicates(spark.createDataFrame([(i,) for i in new], "id string"), blocks, similar, edges)
    got = {r[0]: r[1] for r in inline.groupBy("signal").sum("links").collect()}
    # b0 and b3 are of two types in one scope; b7 and b8 differ in scope; b3 is not new
    assert got == {**fresh, "essence_embedding": 1}


def test_projects_alike_in_concepts_or_words(spark):
    items = spark.createDataFrame([("a", ["X ", "y", "z"], "coffee roasting at home"), ("b", ["x", "y", "z"], "tea"), ("c", None, "roasting coffee with others"), ("d", [], None), ("e", [], None), ("f", ["x", "q"], "that this with")], "id string, concepts array<string>, essence string")
    none = spark.createDataFrame([], EDGE)
    got = {(r.a, r.b): r.signal for r in T.project_duplicates(items, none).collect()}
    assert got == {("a", "b"): "concept", ("a", "c"): "essence"}
    linked = spark.createDataFrame([("c", "a", "part_of", "active", None)], EDGE)
    assert [(r.a, r.b) for r in T.project_duplicates(items, linked).collect()] == [("a", "b")]
    assert T.project_duplicates(items.limit(0), none).count() == 0


def test_a_hot_value_is_one_class(spark):
    rows = spark.range(20000).selectExpr("concat('i', id) AS id", "'s' AS scope", "'fact' AS type", "'the very same claim again' AS value", "array('k') AS concepts")
    (only,) = T.block_duplicates(rows, spark.createDataFrame([], EDGE)).collect()
    assert (only.a, only.b, only.links) == ("i0", "i0", 20000 * 19999 // 2)


def test_attachments_need_every_sign(spark):
    rows = [("1", "attach", True, "home", "beans"), ("2", "attach", None, "home", "beans"), ("3", "attach", True, "away", "beans"), ("4", "attach", True, "home", " "), ("5", "new", True, "home", "beans"), ("6", None, None, None, None)]
    got = T.attachments(spark.createDataFrame(rows, "id string, decision string, same_owner boolean, matched_root string, shared_subject string"), spark.createDataFrame([("home",), ("home",), (None,)], "label string"))
    assert {r.id: (r.action, r.root) for r in got.collect()} == {"1": ("attach", "home"), **{k: ("keep", None) for k in "23456"}}


def test_entities_and_concepts():
    assert R.entities("Fix parser. Then ask Anna about billing") == ["Anna", "parser", "billing", "Fix parser. Then ask Anna about billing"]
    assert R.concepts("How to fix THE parser, fix it!") == ["fix", "parser"]


def test_recall_passes_over_what_does_not_fit(spark):
    nodes = [(f"n{i}", f"brew_{i}", "fact", "brew " + "x" * size, [], None, 6) for i, size in enumerate((1500, 1600, 900, 700, 100, 100, 100, 100))]
    nodes += [("s", "agent_session_brew", "fact", "brew", [], None, 6), ("z", "other", "fact", None, None, None, None)]
    df = spark.createDataFrame(nodes, NODE)
    none = spark.createDataFrame([], EDGE)
    got = R.auto_recall(df, "about brew", spark.createDataFrame([], "id string, similarity double"), spark.createDataFrame([("n7",)], "id string"), none).orderBy("place").collect()
    assert [r.id for r in got if r.shown == "loaded"] == ["n7", "n0", "n2", "n4", "n5"]
    assert {r.id for r in got if r.shown == "hint"} == {"n1", "n3", "n6"}
    assert R.auto_recall(df.limit(0), "", spark.createDataFrame([], "id string, similarity double"), spark.createDataFrame([], "id string"), none, "p").count() == 0


def test_gap_report_kinds(spark):
    from pyspark.sql import functions as F

    from threadloom.operators import audit as A
    from threadloom.sources.graph import now

    rows = [("p", "home", "project", None, 0), ("t", "t", "task", "open", 0), ("u", "u", "task", "Done", 0), ("q", "q", "question", None, 0), ("r", "r", "question", None, 0), ("d", "d", "decision", None, 0), ("x", "x", "dead_end", None, 0), ("y", "y", "dead_end", None, 0), ("w", "w", "draft", None, 30), ("v", "v", "draft", None, 3), ("m", "m", "draft", "promoted", 30), ("s", "agent_session_1", "fact", None, 0)]
    nodes = spark.createDataFrame([(*r, "active") for r in rows], "id string, label string, type string, work_status string, days int, status string").withColumn("created_at", now() - F.make_dt_interval(days="days"))
    edges = spark.createDataFrame([("t", "d", "based_on", "active", None), ("d", "q", "resolves", "active", None), ("q", "y", "contradicts", "active", None), ("r", "x", "about", "active", None), ("w", "v", "about", "active", None), ("v", "m", "about", "active", None), ("u", "d", "about", "ended", None)], EDGE)
    got = {(r.gap, r.id, r.detail) for r in A.gap_report(nodes, edges, spark.createDataFrame([("t", "d")], "id string, detail string"), spark.createDataFrame([("p", "next?")], "id string, detail string"), now()).collect()}
    assert got == {("orphan", "u", None), ("task", "t", "constraint"), ("open_question", "r", None), ("open_conflict", "t", "d"), ("dead_end", "x", None), ("stale_draft", "w", None), ("next_question", "p", "next?")}
