from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.operators import composites as C
from threadloom.operators import flags as L
from threadloom.operators import seams as S
from threadloom.operators import threads as T
from threadloom.operators import traverse, writes
from threadloom.sources.graph import current, now

from .test_graph import T0, edges, nodes

FLAG = "flag_id string, flag_type string, block_a string, block_b string, scope_check string, origin_writer string, reviewed_at timestamp_ntz, verdict string, action string, winner string"


def starts(spark, *ids):
    return spark.createDataFrame([(x,) for x in ids], "start string")


def test_signs(spark):
    n = nodes(
        spark,
        {"id": "a", "type": "fact", "essence": "began"}, {"id": "b", "type": "fact"}, {"id": "c", "type": "decision", "essence": "chose"},
        {"id": "d", "type": "fact", "access_count": 9, "essence": "read"}, {"id": "e", "type": "dead_end", "essence": "failed"}, {"id": "z", "type": "dead_end", "status": "archived"}, {"id": "lone", "type": "fact"},
    )
    spine = edges(spark, ("b", "a", "based_on"), ("c", "b", "based_on"), ("d", "c", "based_on"), ("e", "c", "based_on"), ("z", "c", "based_on"))
    proof = edges(spark, ("x", "b", "supports"), ("y", "b", "supports"), ("x", "other", "supports"))
    got = {r.start: r for r in T.signs(traverse.members(spine, starts(spark, "c", "e", "lone")), n, proof).collect()}
    assert set(got) == {"c", "e"}
    c = got["c"]
    assert (c.lineage, c.leads_to, c.more_leaves, c.backed_by, c.forked, c.terminal, c.arc, c.conclusion) == ("a > c", "e > d", 0, 2, True, False, "began  →  chose", "failed")
    e = got["e"]
    assert (e.lineage, e.leads_to, e.terminal, e.forked, e.conclusion) == ("a > c > e", None, True, False, "failed")


def test_signs_are_short(spark):
    n = nodes(spark, *({"id": f"n{k:02}", "type": "decision"} for k in range(20)))
    line = edges(spark, *((f"n{k + 1:02}", f"n{k:02}", "extends") for k in range(12)), *((f"n{k:02}", "n12", "extends") for k in range(13, 20)))
    r = T.signs(traverse.members(line, starts(spark, "n12")), n, edges(spark)).head()
    assert r.lineage.split(" > ") == ["n00", *(f"n{k:02}" for k in range(6, 13))] and r.more_leaves == 2 and len(r.leads_to.split(" > ")) == 5


def test_whole_threads(spark):
    n = nodes(spark, {"id": "a", "type": "fact"}, {"id": "b", "type": "fact"}, {"id": "c", "type": "fact", "status": "archived"})
    spine = edges(spark, ("b", "a", "based_on"), ("c", "b", "based_on"))
    got = T.whole_threads(traverse.thread(spine, starts(spark, "b")), n, edges(spark, ("b", "q", "supports"))).orderBy("place").collect()
    assert [(r.id, r.role, r.backed_by) for r in got] == [("a", "origin", 0), ("b", "focal", 1)]


def test_linked_threads_come_once(spark):
    n = nodes(spark, *({"id": x, "type": t} for x, t in (("a", "fact"), ("b", "fact"), ("p", "fact"), ("q", "insight"), ("r", "decision"), ("s", "fact"))))
    spine = edges(spark, ("b", "a", "based_on"), ("q", "p", "based_on"), ("r", "p", "based_on"))
    ties = edges(spark, ("a", "p", "related_to"), ("q", "b", "contradicts"), ("a", "s", "supports"), ("a", "b", "supports"), ("s", "p", "supports"))
    members = traverse.members(spine, starts(spark, "a")).select("start", "id")
    got = T.linked_threads(members, spine, ties, n).orderBy("place").collect()
    assert [(r.thread, r.via, r.handle) for r in got] == [("p", "contradicts", "r"), ("s", "supports", "s")]


def test_bounded_chain(spark):
    n = nodes(spark, *({"id": f"n{k:02}", "type": "fact", "essence": "x" * 200} for k in range(20)))
    line = edges(spark, *((f"n{k + 1:02}", f"n{k:02}", "extends") for k in range(19)), ("n10", "n09", "based_on"))
    got = {r.id: r for r in T.bounded_chain(line, starts(spark, "n10"), n).collect()}
    assert sorted(r.depth for r in got.values()) == list(range(-7, 6)) and got["n09"].via == "based_on" and got["n08"].via == "extends" and len(got["n10"].gist) == 121


def test_tree_opens_what_is_not_pinned(spark):
    n = nodes(
        spark,
        {"id": "p", "type": "project"}, {"id": "d", "type": "decision", "project_id": "p"}, {"id": "under_d", "type": "fact", "project_id": "d"},
        {"id": "t", "type": "task", "project_id": "p", "work_status": "in_progress"}, {"id": "e", "type": "entity", "project_id": "p"}, {"id": "f", "type": "decision", "project_id": "e"},
        {"id": "gone", "type": "fact", "project_id": "p", "status": "archived"}, {"id": "q", "type": "project", "project_id": "p"},
    )
    got = {(r.root, r.id): (r.depth, r.role, r.children) for r in T.tree(n).collect()}
    assert got == {("p", "p"): (0, "project", 5), ("q", "q"): (0, "project", 0), ("p", "d"): (1, "decision", 1), ("p", "t"): (1, "active_task", 0), ("p", "e"): (1, "child", 1), ("p", "f"): (2, "child", 0)}


def test_chain_texts(spark):
    n = nodes(spark, {"id": "a", "type": "fact", "label": "web_fact_seen", "essence": "seen"}, {"id": "b", "type": "decision", "label": "web_decision_use_cache", "essence": "use"}, {"id": "c", "type": "fact"}, {"id": "d", "type": "fact"})
    whole, rows = T.chain_texts(n, edges(spark, ("b", "a", "based_on"), ("d", "c", "based_on")))
    assert [(r.label, r.essence, r.conclusion) for r in whole.collect()] == [("web_chain_use-cache", "seen → use", "use")]
    assert [(r.place, r.id) for r in rows.orderBy("place").collect()] == [(1, "a"), (2, "b")]


def test_members_by_edge_go_before_those_by_name(spark):
    n = nodes(spark, *({"id": x, "type": "fact"} for x in "abcd")).join(spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t"), ("d", None)], "id string, chain_id string"), "id")
    got = T.members_in_order(n, edges(spark, ("b", "s", "member_of"), ("d", "s", "member_of")), edges(spark, ("b", "d", "based_on")))
    assert sorted((r.chain, r.place, r.id) for r in got.collect()) == [("s", 1, "d"), ("s", 2, "b"), ("t", 1, "c")]


def test_flags(spark):
    row = lambda k, t="dup", a="a", b="b", scope="same", by="audit", at=None, v=None: (k, t, a, b, scope, by, at, v, None, None)
    f = spark.createDataFrame([row("sure"), row("unsure"), row("wrong"), row("split"), row("reality", "resolution_pending"), row("island", "island_candidate"), row("owner", scope="unknown", by="stage_d_resolve"), row("stale", a="gone"), row("wait"), row("old", at=T0, v="leave"), row("agent", v=L.ASKED)], FLAG)
    judged = spark.createDataFrame([("sure", "merge", "high", "a"), ("unsure", "merge", "medium", "a"), ("wrong", "merge", "high", "q"), ("split", "split", "low", None), ("old", "merge", "high", "a")], "flag_id string, said string, confidence string, winner string")
    n = nodes(spark, {"id": "a", "type": "fact"}, {"id": "b", "type": "fact"})
    after = {r.flag_id: r for r in L.routed(f, n, judged, now()).collect()}
    assert {k: r.step for k, r in after.items()} == {"sure": "merge", "unsure": "ask", "wrong": "ask", "split": "record", "reality": "ask", "island": "defer", "owner": "ask", "stale": "stale", "wait": "wait", "old": "none", "agent": "none"}
    assert after["sure"].winner == "a" and after["old"].verdict == "leave" and after["unsure"].reviewed_at is None
    assert L.routed(f, n, judged, now(), auto_merge=False).filter("flag_id = 'unsure'").head().step == "record"
    assert L.pending(f).count() == 9 and L.asked(f).count() == 1 and L.by_block(f, True).count() == 2
    v = spark.createDataFrame([("agent", 1, "merge", "same", "b", True), ("agent", 2, "leave", "late", None, False), ("wait", 1, "merge", "x", None, True), ("split", 1, "leave", " ", None, False), ("old", 1, "leave", "x", None, False)], "flag_id string, seq int, said string, reason string, winner string, execute boolean")
    done, outcome = L.applied(f, v, now())
    assert {(r.flag_id, r.seq): r.outcome for r in outcome.collect()} == {("agent", 1): "ok", ("agent", 2): "ALREADY_REVIEWED", ("wait", 1): "WINNER_REQUIRED", ("split", 1): "REASON_REQUIRED", ("old", 1): "ALREADY_REVIEWED"}
    assert done.filter("flag_id = 'agent'").head().action == L.MERGED and done.count() == 11


def test_demotion(spark):
    rows = [("1", "insight", "web_insight_x", {"observation": "o"}), ("2", "insight", "WEB_insight_x", {"observation": "o"}), ("3", "insight", "web_insight_y", {"observation": "o"}), ("4", "fact", "web_fact_y", {"value": "v"}), ("5", "insight", "insight", {"observation": "o"}), ("6", "insight", "web_insight_z", {"observation": " "}), ("7", "insight", "web_insight_q", {"observation": "o", "mood": "m"})]
    got = {r.id: (r.type, r.label, r.state) for r in S.healed(spark.createDataFrame(rows, "id string, type string, label string, payload map<string,string>")).collect()}
    assert got["1"] == ("fact", "web_fact_x", "healed") and got["2"][2] == got["3"][2] == "collided" and all(got[k][2] == "skipped" for k in "4567")


def test_labels_and_budget(spark):
    r = spark.range(1).select(S.repaired_label(F.lit("web_dead_end"), ("dead_end",)).alias("a"), S.valid_segments(F.lit("a_b_dead_end_c"), ("dead_end",)).alias("b"), S.valid_segments(F.lit("a_b_c_d_e"), ("dead_end",)).alias("c")).head()
    assert tuple(r) == ("web_dead-end", True, False)
    rows = [(None, None, "ok", 0.0, 9.0), (5.0, None, "error", None, 0.0), (5.0, None, "ok", 4.0, 0.0), (5.0, 2.0, "unconfigured", None, 2.0), (5.0, 2.0, "ok", 6.0, 1.0)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, f double, c double, credit string, l double, s double").select("k", S.budget(F.col("f"), F.col("c"), F.col("credit"), F.col("l"), F.col("s")).alias("v"))
    assert [r.v for r in got.orderBy("k").collect()] == ["off", "closed", "floor", "cap", "ok"]


def payloads(spark, n, **of):
    return n.join(spark.createDataFrame([(k, v) for k, v in of.items()] or [("", {"": ""})], "id string, payload map<string,string>"), "id", "left")


def test_created_merges_payloads(spark):
    old = payloads(spark, nodes(spark, {"id": "a", "type": "fact", "label": "x"}, {"id": "b", "type": "fact", "label": "y", "status": "archived", "essence": "old"}), a={"k": "1", "m": "1"})
    new = payloads(spark, nodes(spark, {"id": "p", "type": "fact", "label": "X"}, {"id": "q", "type": "fact", "label": "Y", "essence": "new"}), p={"k": "2", "n": "2"})
    got = {r.id: r for r in writes.created(old, new, now()).collect()}
    assert got["a"].payload == {"k": "2", "m": "1", "n": "2"} and (got["b"].status, got["b"].essence) == ("active", "new") and set(got) == {"a", "b"}


def test_locked_nodes_and_decided_edges(spark):
    n = nodes(spark, {"id": "a", "type": "fact"}).withColumn("locked", F.lit(True))
    change = spark.createDataFrame([("a", "essence", "x", 1)], "id string, field string, value string, seq int")
    with pytest.raises(PermissionError):
        writes.updated(n, change, now())
    assert writes.updated(n, change, now(), force=True)[0].head().essence == "x"
    e = edges(spark, ("a", "b", "extends"), ("a", "c", "extends"), ("a", "d", "extends")).withColumn("status", F.when(F.col("target_id") != "d", "pending").otherwise("active"))
    d = spark.createDataFrame([("a", "b", "extends", "approve", None), ("a", "c", "extends", "reject", None), ("a", "d", "extends", "reject", None)], "source_id string, target_id string, type string, decision string, new_type string")
    assert {(r.target_id, r.status) for r in writes.decided(e, d).collect()} == {("b", "active"), ("d", "active")}
    again = spark.createDataFrame([("a", "d", "extends", "retype", "resolves")], d.schema)
    assert writes.decided(e, again).filter("type = 'resolves'").count() == 1


def test_remember_and_derive(spark):
    n = payloads(spark, nodes(spark, {"id": "a", "type": "fact", "concepts": ["u", "v"]}, {"id": "b", "type": "fact", "concepts": ["v", "w"]}), a={"value": "1"})
    e = edges(spark)
    new = payloads(spark, nodes(spark, {"id": "c", "type": "decision", "concepts": ["x", "y", "z"], "quality": 1}), c={"is_a": "choice", "choice": "q", "reason": "r"})
    ties = spark.createDataFrame([("c", "A", "based_on"), ("c", "nowhere", "based_on")], "source_label string, target_label string, type string")
    n2, e2 = C.remembered(n, e, new, ties, now())
    assert [(r.source_id, r.target_id) for r in e2.collect()] == [("c", "a")] and n2.filter("id = 'c'").head().quality == 5
    made = spark.createDataFrame([("d", None, "thus the caches matter", ["b", "a", "b"], None, None, True), ("x", None, "no", ["404", "a"], None, None, True)], "id string, label string, conclusion string, inputs array<string>, concepts array<string>, type string, promote boolean")
    n3, e3, stamps = C.derived(n2, e2, made, now())
    d = n3.filter("id = 'd'").head()
    assert (d.label, d.type, d.ttl, d.concepts, d.quality) == ("derived_d", "insight", "permanent", ["v", "w", "u"], 5) and n3.filter("id = 'x'").isEmpty()
    assert e3.filter("type = 'derived_from'").count() == 2 and {(r.id, r.flow_role) for r in stamps.collect()} == {("a", "cause"), ("b", "cause"), ("d", "outcome")}
    assert spark.range(1).select(C.tags_of(F.lit("Thus the Caches, caches matter!"))).head()[0] == ["caches", "matter"]


def test_challenge_resolve_forget_keep(spark):
    n = payloads(spark, nodes(spark, {"id": "a", "type": "fact", "essence": "e"}, {"id": "b", "type": "fact", "ttl": "permanent"}))
    e = edges(spark, ("a", "b", "extends"), ("b", "a", "extends"))
    n2, e2 = C.challenged(n, e, spark.createDataFrame([("q", "a", "why"), ("r", "404", "why")], "id string, target string, reasoning string"), now())
    assert n2.filter("id = 'q'").head().essence == "Challenge to: e" and e2.filter("type = 'challenges'").count() == 1 and n2.count() == 3
    acts = spark.createDataFrame([("a", "keep_this", "b"), ("a", "keep_other", None), ("404", "archive_this", None), ("a", "odd", None)], "id string, action string, other string")
    n3, e3, out = C.resolved(n, e, acts, now())
    assert sorted(r.outcome for r in out.collect()) == ["BLOCK_NOT_FOUND", "INVALID_ACTION", "OTHER_REQUIRED", "ok"]
    assert {(r.id, r.status) for r in n3.collect()} == {("a", "active"), ("b", "archived")} and current(e3).count() == 1
    n4, history = C.kept(n, spark.createDataFrame([("a", "new", None), ("b", "other", None)], "id string, label string, type string"), now())
    assert {(r.id, r.label, r.ttl) for r in n4.collect()} == {("a", "new", "permanent"), ("b", "b", "permanent")} and history.count() == 2
    assert n4.filter("id = 'a'").head().updated_at > T0 - dt.timedelta(1)
