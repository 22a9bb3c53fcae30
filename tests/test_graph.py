from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom import catalog
from threadloom.functions.scoring import cosine
from threadloom.functions.text import gist, stem
from threadloom.operators import audit, items, reads, search, temporal, traverse, writes
from threadloom.sources.graph import EDGE_COLUMNS, NODE_COLUMNS, at, current, now
from threadloom.streaming import jobs

NODE = "id string, label string, type string, status string, ttl string, project_id string, essence string, concepts array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, access_count bigint, quality bigint, work_status string, priority string"
EDGE = "source_id string, target_id string, type string, status string, created_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def nodes(spark, *rows):
    base = {"status": "active", "ttl": "project", "essence": "", "concepts": [], "created_at": T0, "updated_at": T0, "access_count": 0, "quality": 3}
    made = [base | {"label": r["id"]} | r for r in rows]
    return spark.createDataFrame([tuple(m.get(c) for c in NODE_COLUMNS) for m in made], NODE)


def edges(spark, *rows):
    made = [{"status": "active", "created_at": T0, "valid_from": T0} | dict(zip(("source_id", "target_id", "type"), r, strict=False)) for r in rows]
    return spark.createDataFrame([tuple(m.get(c) for c in EDGE_COLUMNS) for m in made], EDGE)


def test_line_of_causes(spark):
    e = edges(spark, ("dec", "fact", "based_on"), ("fact", "event", "based_on"))
    start = spark.createDataFrame([("fact",)], "start string")
    got = {r.id: (r.depth, r.role) for r in traverse.thread(e, start).collect()}
    assert got == {"event": (-1, "origin"), "fact": (0, "focal"), "dec": (1, "leaf")}


def test_walk_ends_on_cycles(spark):
    e = edges(spark, ("a", "b", "extends"), ("b", "c", "extends"), ("c", "a", "extends"))
    start = spark.createDataFrame([("a",)], "start string")
    assert {r.id: r.depth for r in traverse.walk(e, start, True).collect()} == {"a": 0, "b": 1, "c": 2}


def test_walks_have_no_last_level(spark):
    ids = [f"n{k:03}" for k in range(306)]
    e = edges(spark, *((b, a, "prompted_by") for a, b in zip(ids, ids[1:], strict=False))).coalesce(1)
    start = spark.createDataFrame([("n305",)], "start string")
    assert {r.id: r.depth for r in traverse.walk(e, start, True).collect()} == {x: 305 - k for k, x in enumerate(ids)}
    assert traverse.walk(e, start, True, 9).count() == 10
    n = nodes(spark, *({"id": x, "type": "fact"} for x in ids))
    assert items.rescued(n, e, start.withColumnRenamed("start", "id")).count() == 306


def test_top_roots_have_no_last_level_and_cycles_end(spark):
    up = [(f"p{k:02}", f"p{k - 1:02}" if k else None) for k in range(12)] + [("x", "z"), ("y", "x"), ("z", "y"), ("w", "z"), ("s", "s"), ("u", "gone")]
    got = {r.id: (r.top, r.up_levels) for r in traverse.top_roots(spark.createDataFrame(up, "id string, project_id string")).collect()}
    assert got == {f"p{k:02}": ("p00", k) for k in range(12)} | {"x": ("x", 0), "y": ("x", 1), "z": ("x", 2), "w": ("x", 3), "s": ("s", 0), "u": ("u", 0)}


def test_causal_order_beats_time(spark):
    late_cause = spark.createDataFrame([("t", "effect", T0), ("t", "cause", T0 + dt.timedelta(1)), ("t", "other", T0 + dt.timedelta(2))], "chain string, id string, created_at timestamp_ntz")
    got = traverse.causal_order(late_cause, edges(spark, ("effect", "cause", "based_on"))).orderBy("place").collect()
    assert [r.id for r in got] == ["cause", "effect", "other"]


def test_only_chains_out_of_time_are_ordered_edge_by_edge(spark):
    time = lambda d: None if d is None else T0 + dt.timedelta(d)
    rows = [("t", "a", 0), ("t", "b", 1), ("t", "c", 1), ("t", "z", None), ("u", "a", 5), ("u", "b", 3), ("v", "x", 0), ("v", "y", 1), ("w", "a", 2), ("w", "a", 2), ("w", "c", 1)]
    members = spark.createDataFrame([(c, i, time(d)) for c, i, d in rows], "chain string, id string, created_at timestamp_ntz")
    # t: b and c are of one time; u: the cause is newer; v: a cycle; an edge to another chain is none
    e = edges(spark, ("c", "b", "based_on"), ("z", "a", "based_on"), ("b", "a", "based_on"), ("x", "y", "based_on"), ("y", "x", "based_on"), ("x", "a", "based_on"))
    assert {r.chain for r in traverse.inner_edges(members, e).filter("late").collect()} == {"u", "v"}
    got = sorted((r.chain, r.place, r.id) for r in traverse.causal_order(members, e).collect())
    assert got == [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("t", 4, "z"), ("u", 1, "a"), ("u", 2, "b"), ("v", 1, "x"), ("v", 2, "y"), ("w", 1, "c"), ("w", 2, "a")]


def test_components_and_chains(spark):
    n = nodes(spark, *({"id": i, "type": t} for i, t in (("a", "event"), ("b", "fact"), ("c", "decision"), ("d", "fact"), ("e", "task"))))
    e = edges(spark, ("b", "a", "based_on"), ("c", "b", "based_on"), ("e", "d", "prompted_by"))
    assert {r.id: r.component for r in traverse.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert [tuple(r) for r in traverse.chains(n, e).collect()] == [("a", 3, "c", "decision")]
    assert traverse.components(e.limit(0)).count() == 0


def test_only_edges_between_roots_relate_them(spark):
    n = nodes(
        spark, {"id": "r1", "type": "project"}, {"id": "r2", "type": "project"}, {"id": "r3", "type": "project"},
        {"id": "a", "type": "fact", "project_id": "r1"}, {"id": "b", "type": "fact", "project_id": "r2"}, {"id": "c", "type": "fact", "project_id": "r1"},
    )
    e = edges(spark, ("a", "b", "based_on"), ("a", "b", "depends_on"), ("b", "c", "supersedes"), ("a", "b", "related_to"), ("a", "c", "based_on"), ("a", "b", "member_of"))
    pairs, alone = traverse.root_relatedness(n, e)
    (p,) = pairs.collect()
    assert (p.root_a, p.root_b, p.dependency, p.evolution, p.loose, p.total, p.parent) == ("r1", "r2", 2, 1, 1, 4, "r2")
    assert [r.id for r in alone.collect()] == ["r3"]


def test_reads(spark):
    n = nodes(spark, {"id": "A", "type": "task", "label": "Fix_it"}, {"id": "B", "type": "fact", "status": "archived"})
    assert [r.id for r in reads.by_key(n, "fix_IT").collect()] == ["A"]
    assert [r.id for r in reads.listed(n).collect()] == ["A"]
    e = edges(spark, ("A", "B", "supersedes"), ("A", "B", "resolves"))
    assert sorted(r.seen_as for r in reads.incoming(e).collect()) == ["resolves", "superseded_by"]
    with pytest.raises(LookupError):
        reads.known_project(n, "none")


def test_semantic_search(spark):
    """Every query against all vectors, in blocks, as numpy has it."""
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    size, search.BLOCK = search.BLOCK, 64
    got = search.semantic_search(v, v.filter("vec_id % 50 = 0"), 7).collect()
    search.BLOCK = size
    for q in range(0, 300, 50):
        want = [k for k in np.argsort(-(unit @ unit[q]), kind="stable")[:7] if unit[k] @ unit[q] > 0.2]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)] == want
    assert {r.query_id for r in got} == set(range(0, 300, 50))


def test_scope_chains(spark):
    """Chains of any depth up to the most, unknown containers and cycles."""
    named = spark.createDataFrame([(f"n{k}", f"L{k}") for k in range(12)] + [("x", "X"), ("y", "Y"), ("lone", "Lone")], "id string, label string")
    e = edges(spark, *((f"n{k}", f"n{k + 1}", "part_of") for k in range(11)), ("x", "y", "part_of"), ("y", "x", "part_of"), ("lone", "unknown", "part_of"))
    got = {r.id: r.scope for r in traverse.scope_chains(named, e, named).collect()}
    assert got["lone"] == "Lone" and got["n9"] == "L11 > L10 > L9" and got["n0"] == " > ".join(f"L{k}" for k in range(7, -1, -1))
    assert got["x"].count(" > ") == 7 and len(got) == 15


def test_search(spark):
    n = nodes(spark, {"id": "read", "type": "fact", "essence": "pool timeout", "access_count": 50}, {"id": "match", "type": "fact", "essence": "pool exhausted", "concepts": ["connection pool"]})
    assert search.keyword_search(n, "the and of", 5).count() == 0
    assert [r.id for r in search.keyword_search(n, "why is pool exhausted", 5).collect()] == ["read", "match"]
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    near = spark.createDataFrame([(2, "match", 0.9)], "query_id bigint, id string, similarity double")
    got = search.hybrid(asked, near, search.keyword_hits(n, ["exhausted"]), search.concept_hits(n, ["pool"]), n, 5)
    assert {(r.query_id, r.id, r.match_types) for r in got.collect()} == {(1, "match", "concept+keyword"), (2, "match", "concept+keyword+semantic")}
    assert {r.query_id: r.weak for r in search.is_weak(got).collect()} == {1: True, 2: False}
    # equal scores: the newest first, then the smallest id
    rows = [("a", "2024-01-01"), ("b", "2024-01-03"), ("c", "2024-01-03"), ("d", "2024-01-02")]
    dated = spark.createDataFrame(rows, "id string, t string").select("id", F.lit(1).alias("access_count"), F.to_timestamp_ntz("t").alias("updated_at"))
    tied = search.hybrid(asked.limit(1), near.limit(0), dated, spark.createDataFrame([], "id string, matched bigint"), dated, 2)
    assert [r.id for r in tied.orderBy("place").collect()] == ["b", "c"]
    v = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0]), (2, [3.0, 4.0], [4.0, 3.0]), (3, None, [1.0])], "k int, a array<double>, b array<double>")
    assert [round(r.c, 4) for r in v.orderBy("k").select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 0.96, 0.0]


def test_text(spark):
    w = spark.createDataFrame([(x,) for x in ("nation", "testing", "birds", "was", "bus", "lily")], "w string")
    assert [r.s for r in w.select(stem(F.col("w")).alias("s")).collect()] == ["n", "test", "bird", "was", "bus", "li"]
    assert w.select(gist(F.lit("one two"), 4).alias("g")).head().g == "one…"


def test_retention(spark):
    old = {"updated_at": T0 - dt.timedelta(90)}
    n = nodes(
        spark, {"id": "hot", "type": "fact", "ttl": "session", "access_count": 3} | old, {"id": "gone", "type": "fact", "ttl": "1hr"} | old, {"id": "tied", "type": "fact", "ttl": "1hr"} | old,
        {"id": "rule", "type": "constraint", "ttl": "1hr"} | old, {"id": "stays", "type": "fact", "ttl": "project"} | old,
    )
    got = {r.id: r.action for r in audit.collected(n, edges(spark, ("x", "tied", "based_on")), now()).collect()}
    assert got == {"hot": "protect", "gone": "archive", "tied": "protect", "rule": "protect", "stays": "keep"}


def test_merge_moves_edges_once(spark):
    e = edges(spark, ("x", "loser", "based_on"), ("x", "winner", "based_on"), ("loser", "winner", "extends"), ("loser", "y", "part_of"))
    got = {tuple(r) for r in audit.merged(e, spark.createDataFrame([("loser", "winner")], "loser string, winner string")).collect()}
    assert got == {("x", "winner", "based_on"), ("winner", "loser", "supersedes")}


def test_provenance(spark):
    claims = spark.createDataFrame([(1, "The Pool  timed out"), (2, "pool of many words here"), (3, "nothing alike"), (4, "x")], "id int, excerpt string")
    texts = spark.createDataFrame([(1, "so the pool\ntimed OUT."), (2, "words many of pool here"), (3, "other")], "id int, text string")
    assert {r.id: r.state for r in audit.provenance(claims, texts).collect()} == {1: "exact", 2: "fuzzy", 3: "missing", 4: "no_link"}


def test_every_passage_is_looked_for_in_every_text(spark, tmp_path):
    long = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"
    passages = {0: long, 41: "The  quick brown Fox jumps", 77: "pure luck", 150: "cut words here now", 199: "", 300: None, 301: "é!", 302: "ut wor", 303: "pure-luck"}
    texts = {
        1: f"so {long} and the quick\nbrown fox jumps.", 41: "UNCUT words here nowadays", 2: " ".join(reversed(long.split()[:17])), 3: " ".join(long.split()[3:19]), 77: "a pure luck", 40: None, 5: "", 6: "olé! x",
    }
    spark.createDataFrame(list(passages.items()), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["g18_held_passages"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, -1 if r.item_id is None else r.item_id, r.state) for r in got) == [
        (1, 0, "exact"), (1, 41, "exact"), (2, 0, "fuzzy"), (3, -1, "missing"), (5, -1, "missing"), (6, 301, "exact"), (40, -1, "missing"), (41, 150, "exact"), (41, 302, "exact"), (77, 77, "exact"), (77, 303, "fuzzy"),
    ]


def test_items(spark):
    p = spark.createDataFrame([("fact", {"value": " v ", "z": "1"}), ("dead_end", {"reason": "r"}), ("note", {"b": "2", "a": " "}), ("insight", {"observation": "o", "odd": "x"})], "type string, u map<string,string>")
    got = p.select(items.primary_value(F.col("type"), F.col("u")).alias("v"), items.checked(F.col("type"), F.col("u")).alias("c")).collect()
    assert [r.v for r in got] == ["v", "r", "2", "o"]
    assert [(r.c.missing, r.c.extras) for r in got] == [([], ["z"]), (["approach"], []), ([], []), (["implication"], ["odd"])]
    n = nodes(spark, {"id": "f", "type": "fact"}, {"id": "d", "type": "decision"}, {"id": "g", "type": "fact"})
    assert [tuple(r) for r in items.folds(edges(spark, ("d", "f", "based_on"), ("d", "g", "prompted_by")), n).collect()] == [("f", "d")]
    kept = spark.createDataFrame([("d",)], "id string")
    assert {r.id for r in items.rescued(n, edges(spark, ("d", "f", "based_on")), kept).collect()} == {"d", "f"}


def test_time(spark):
    hours = [0, 1, 2, 20, 21, 50]
    e = spark.createDataFrame([(1, k, T0 + dt.timedelta(hours=h), 1.0) for k, h in enumerate(hours)], "user_id bigint, event_id bigint, ts timestamp_ntz, value double")
    assert sorted(r.events for r in temporal.sessions(e, "user_id").collect()) == [1, 2, 3]
    assert [r.event_id for r in temporal.cooled(e, "user_id", "event_id", 7200).orderBy("ts").collect()] == [0, 2, 3, 5]
    assert [r.fired for r in temporal.triggers(e, "user_id", [F.col("ts")], 2).orderBy("ts").collect()] == [1, 2, 3]


def test_writes(spark):
    n = nodes(spark, {"id": "1", "type": "fact", "label": "Old", "status": "archived"}, {"id": "2", "type": "fact"})
    after = writes.created(n, nodes(spark, {"id": "9", "type": "fact", "label": "old"}, {"id": "8", "type": "fact", "label": "new"}, {"id": "7", "type": "fact", "label": "NEW"}), now())
    assert {(r.id, r.status) for r in after.collect()} == {("1", "active"), ("2", "active"), ("7", "active")}
    changes = spark.createDataFrame([("2", "essence", "a", 1), ("2", "essence", "b", 2), ("2", "quality", "3", 1)], "id string, field string, value string, seq int")
    nxt, history = writes.updated(n, changes, now())
    assert nxt.filter("id = '2'").head().essence == "b" and nxt.filter("id = '1'").head().updated_at == T0
    assert [(r.field, r.old_value, r.new_value) for r in history.collect()] == [("essence", "", "b")]
    with pytest.raises(ValueError):
        writes.updated(n, spark.createDataFrame([("2", "id", "x", 1)], "id string, field string, value string, seq int"), now())
    e = edges(spark, ("1", "2", "based_on"), ("2", "1", "extends"))
    more = writes.linked(e, edges(spark, ("1", "2", "based_on"), ("1", "2", "extends"), ("1", "404", "extends")), n)
    assert more.count() == 3
    gone, left = writes.archived(n, e, spark.createDataFrame([("1",)], "id string"), now())
    assert current(left).count() == 1 and gone.filter("status = 'archived'").count() == 1
    log = spark.createDataFrame([("t", 1, "captured"), ("t", 2, "extracted")], "key string, seq int, status string")
    assert [r.legal for r in writes.status_steps(log).orderBy("seq").collect()] == [True, False]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(u, T0 + dt.timedelta(hours=h), "view" if h % 2 else "click", 1.0) for u in range(3) for h in (0, 1, 2, 20, 21, 50)]
    batch = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, event_type string, value double")
    batch.write.parquet(str(tmp_path / "in"))
    schema = "user_id bigint, ts timestamp_ntz, event_type string, value double"
    for name, made in (("daily", jobs.daily), ("fired", lambda s: jobs.counted(s, 2))):
        jobs.to_parquet(made(jobs.event_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / name), str(tmp_path / f"c_{name}")).awaitTermination()
    day = spark.read.parquet(str(tmp_path / "daily"))
    closed = batch.filter(F.col("ts") < at("2024-01-02 00:00:00")).count()
    assert day.agg(F.sum("n")).head()[0] == closed
    assert spark.read.parquet(str(tmp_path / "fired")).groupBy("user_id").count().collect()[0]["count"] == 3


def test_snapshots_keep_the_newest(spark, tmp_path):
    for k in range(4):
        left = writes.snapshot(spark.range(1), f"file://{tmp_path}", f"s{k}", keep=2)
    assert left == ["s3", "s2"]


def test_gaps_put_nodes_and_edges_together_without_joins(spark):
    from threadloom.operators.audit import gaps

    nodes = spark.createDataFrame([("t", "task", "active"), ("t", "task", "active"), ("u", "task", "active"), ("d", "dead_end", "active"), ("e", "dead_end", "active"), ("f", "fact", "active"), ("g", "fact", "archived"), (None, "fact", "active")], "id string, type string, status string")
    end = "2024-01-01 00:00:00"
    rows = [("u", "f", "based_on", "active", None), ("d", "x", "contradicts", "active", None), ("e", "f", "contradicts", "active", end), ("e", "u", "affects", "active", None), ("t", "f", "prompted_by", "pending", None), (None, "t", "affects", "active", None)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, type string, status string, valid_to string").withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))
    found = gaps(nodes, edges)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("dead_end_without_conflict", "e"), ("orphan", None), ("task_without_cause", "t"), ("task_without_cause", "t")], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.columns == ["gap", "id"]
