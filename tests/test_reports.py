from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from threadloom.operators import reports, temporal, upkeep
from threadloom.sources.graph import now

DAY = dt.datetime(2024, 1, 1)
NODE = "id string, label string, type string, project_id string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_scopes_by_label_and_what_is_beyond_them(spark):
    nodes = spark.createDataFrame(
        [("a", "app", "project", None), ("b", "app_web", "project", "a"), ("c", "ops", "project", None), ("t1", "x", "task", "a"), ("t2", "app_web_login", "task", None), ("t3", "y", "task", "b"),
         ("t4", "ops_app", "task", "c"), ("t5", None, "task", "c"), ("t6", "app", "task", "gone"), ("t7", "", "task", None)],
        NODE,
    )
    edges = spark.createDataFrame([("b", "a", "part_of"), ("t1", "t4", "based_on"), ("t5", "t3", "affects"), ("t6", "t7", "affects")], "source_id string, target_id string, type string")
    got = rows(reports.disclosed(nodes, edges, ["task"]), "root", "place", "other", "n")
    # app has t1 and t2 (its label begins with app_); of app_web only t3 is beyond that
    assert got == sorted(
        [("a", "own", None, 2), ("b", "own", None, 2), ("c", "own", None, 2), ("a", "sub_root", "b", 1), ("a", "entangled", "c", 2), ("b", "entangled", "a", 1), ("b", "entangled", "c", 2), ("c", "entangled", "a", 2), ("c", "entangled", "b", 2)],
        key=repr,
    )
    assert reports.disclosed(nodes.limit(0), edges, ["task"]).count() == 0


def test_root_tree_takes_edges_before_the_column(spark):
    nodes = spark.createDataFrame([("a", "top", "project", None, "A"), ("b", "mid", "project", "c", "B"), ("c", "low", "project", "c", None), ("t", "x", "task", "b", ""), ("u", "y", "task", "b", "")], NODE + ", essence string")
    part_of = spark.createDataFrame([("b", "a"), ("b", "zz"), ("c", "c")], "source_id string, target_id string")
    pairs = spark.createDataFrame([("a", "b", 3), ("a", "c", 5), ("b", "gone", 9)], "root_a string, root_b string, total int")
    got = [tuple(r) for r in reports.root_tree(nodes, part_of, pairs, 1).select("label", "blocks", "parent_root", "child_roots", "entangled_with").collect()]
    # by the column b and c are members of c; c's own name there is no parent
    assert got == [("low", 2, None, [], ["top"]), ("top", 0, None, ["mid"], ["low"]), ("mid", 2, "top", [], ["top"])]


def test_briefing_fills_sparse_projects_and_limits_sections(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    data = [("p", "p", "project", None, None, False, day(0), day(0)), ("q", "q", "project", None, None, False, day(0), day(0))]
    data += [(f"f{n:02}", "f", "fact", "p", None, n % 2 == 0, day(n), day(n + 1)) for n in range(30)]
    data += [("t1", "t", "task", "p", "DONE", False, day(0), day(0)), ("t2", "t", "task", "p", None, True, day(0), day(0)), ("k", "k", "constraint", "p", None, False, day(0), day(0))]
    nodes = spark.createDataFrame(data, "id string, label string, type string, project_id string, work_status string, derived boolean, created_at timestamp_ntz, updated_at timestamp_ntz")
    got = reports.briefing(nodes, recent=4)
    assert rows(got.filter("project = 'p' AND section IN ('open_tasks', 'constraints')"), "section", "place", "id", "updated_at") == [("constraints", None, "k", None), ("open_tasks", None, "t2", None)]
    assert rows(got.filter("project = 'p' AND section = 'derived'"), "place", "id") == [(n + 1, f"f{28 - 2 * n:02}") for n in range(5)]
    assert sorted(tuple(r) for r in got.filter("project = 'p' AND section = 'other'").select("place", "id").collect()) == [(n + 1, f"f{29 - 2 * n:02}") for n in range(10)]
    assert rows(got.filter("project = 'q'"), "section", "place", "id") == [("derived", 1, "f28"), ("derived", 2, "f26"), ("other", 1, "f29"), ("other", 2, "f27")]
    assert reports.briefing(nodes.limit(0)).count() == 0


def test_changes_since_look_at_the_latest_only(spark):
    nodes = spark.createDataFrame([("a", "fact", DAY, DAY + dt.timedelta(9)), ("b", "fact", DAY + dt.timedelta(8), DAY + dt.timedelta(9)), ("c", "fact", DAY, DAY)], "id string, type string, created_at timestamp_ntz, updated_at timestamp_ntz")
    history = spark.createDataFrame([(f"n{k}", "essence", DAY + dt.timedelta(k), k) for k in range(20)], "node_id string, field string, at timestamp_ntz, seq int")
    time = F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")
    got = rows(reports.since(nodes, history, time, looked_at=10, shown=3), "section", "place", "id")
    assert got == sorted([("new", None, "b"), ("updated", None, "a"), ("changes", 1, "n19"), ("changes", 2, "n18"), ("changes", 3, "n17")], key=repr)
    assert reports.since(nodes, history, time, looked_at=18, shown=100).filter("section = 'changes'").count() == 14


def test_session_report_by_hand(spark):
    cycles = spark.createDataFrame([("s", 1, 100, 10, True, "2"), ("s", 2, 150, 21, True, None), ("s", 3, 1, None, False, "2"), (None, 4, 5, 5, True, "1"), ("r", 5, 7, 7, None, None)], "k string, cycle int, billed bigint, lag_ms bigint, limited boolean, limit_pass string")
    writes = spark.createDataFrame([(1, "fact", 0.2, True), (1, "fact", 3.5, True), (2, "task", 9.0, True), (2, "task", 4.0, False), (2, "note", 1.0, None), (4, "fact", 1.0, True), (9, "fact", 1.0, True)], "cycle int, type string, quality double, created boolean")
    recalls = spark.createDataFrame([("s", 8, 1), ("t", 0, 0), (None, 1, 1)], "k string, injected bigint, crossed bigint")
    got = {r["k"]: r.asDict(recursive=True) for r in reports.session_report(cycles, writes, recalls, "k").collect()}
    s = got["s"]
    assert (s["cycles"], s["created"], s["updated"], s["billed"], s["cost_per_block"], s["limit_hits"]) == (3, 3, 2, 251, 84, 2)
    assert [s[f"q{n}"] for n in range(1, 7)] == [1, 0, 0, 1, 0, 1] and s["types"] == [{"type": "fact", "n": 2}, {"type": "task", "n": 1}]
    assert (s["density_pct"], s["update_pct"], s["avg_lag_ms"], s["max_lag_ms"], s["pollution_pct"]) == (33, 40, 16, 21, 13) and s["limits"] == [{"limit_pass": "2", "n": 1}]
    assert got["r"]["cycles"] == 1 and got["r"]["cost_per_block"] == 0 and got["t"]["recalls"] == 1 and got["t"]["pollution_pct"] == 0 and set(got) == {"s", "r", "t"}


def test_extraction_reports_by_hand(spark):
    turns = spark.createDataFrame([(1, 5, "pass01_done", "b", None), (1, 6, "pass01_done", "a", "late"), (1, 7, "pass01_done", "b", "worse"), (1, 8, "pass01_done", "c", None), (1, 9, "pass01_done", "d", None), (1, 4, "extracted", "z", "old"), (2, 1, "pass01_done", None, None), (3, 1, "captured", "x", None)], "k int, turn int, status string, name string, error string")
    got = rows(reports.pending_extraction(turns, "k"), "k", "turns", "first", "last", "topics", "failed", "last_error")
    assert got == [(1, 5, 5, 9, ["b", "a", "c"], True, "worse"), (2, 1, 1, 1, [], False, None)]
    ranges = spark.createDataFrame([(1, f"r{n}", n, n + 1, DAY + dt.timedelta(n)) for n in range(4)], "k int, range_id string, first int, last int, at timestamp_ntz")
    nodes = spark.createDataFrame([("a", "web_x", "fact", "c"), ("b", "web_y", "fact", "c"), ("d", "app_x", "fact", "a"), ("c", "story", "chain", None), ("e", None, "fact", "zz")], "id string, label string, type string, chain_id string")
    extracted = spark.createDataFrame([("r3", "a"), ("r3", "b"), ("r3", "d"), ("r2", "d"), ("r2", "c"), ("r1", "e"), ("r0", "a")], "range_id string, id string")
    got = rows(reports.recent_extractions(ranges, extracted, nodes, "k", 3), "place", "topic", "turns", "blocks", "chain")
    assert got == [(1, "web", "3-4", 3, "story"), (2, "app", "2-3", 2, "story"), (3, "turns 1-2", "1-2", 1, None)]


def test_sweep_prefers_what_supersedes(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    nodes = spark.createDataFrame(
        [("t1", "t1", "task", "p", day(5), "open"), ("t2", "t2", "task", None, day(5), None), ("t3", "t3", "task", "p", day(5), "shipped"), ("t4", "t4", "blueprint", "p", day(5), "wip"), ("t5", "t5", "task", "p", day(5), "todo"), ("t6", "t6", "task", "p", day(5), "todo"),
         ("old", "old", "fact", "p", day(1), None), ("f1", "f1", "fact", "q", day(7), None), ("f2", "f2", "decision", None, day(9), None), ("q1", "q1", "question", "p", day(9), None)],
        NODE + ", created_at timestamp_ntz, work_status string",
    )
    edges = spark.createDataFrame(
        [("old", "t1", "supersedes"), ("f1", "t1", "based_on"), ("t2", "f1", "related_to"), ("f2", "t2", "based_on"), ("f1", "t3", "based_on"), ("q1", "t4", "based_on"), ("t4", "old", "supersedes"), ("f1", "t5", "based_on"), ("f1", "t6", "based_on"), ("gone", "t6", "supersedes")],
        "source_id string, target_id string, type string",
    )
    flags = spark.createDataFrame([("resolution_pending", "x", "t5", None), ("provenance", "t6", None, None), ("resolution_pending", "t1", None, DAY)], "flag_type string, block_a string, block_b string, reviewed_at timestamp_ntz")
    sweep = upkeep.swept(nodes, edges, flags, ["t6"])
    assert rows(sweep, "id", "candidate", "signal", "scope_check", "outcome") == [
        ("t1", "old", "superseded", "same", "flagged"), ("t2", "f2", "neighbour", "unknown", "flagged"), ("t4", None, None, None, "none"), ("t5", "f1", "neighbour", "unknown", "existing"), ("t6", None, None, None, "excluded"),
    ]
    assert rows(upkeep.sweep_flags(sweep), "block_a", "block_b", "verdict") == [("t1", "old", "pending_clarification"), ("t2", "f2", "pending_clarification")]
    # a second sweep over what the first wrote adds nothing
    again = upkeep.swept(nodes, edges, flags.unionByName(upkeep.sweep_flags(sweep).select(*flags.columns)), ["t6"])
    assert again.filter("outcome = 'flagged'").count() == 0 and upkeep.swept(nodes.limit(0), edges, flags).count() == 0


def test_conflicts_are_found_once_and_resolved_once(spark):
    conflict = "conflict_id string, block_a string, block_b string, similarity double, detected_at timestamp_ntz, resolution string"
    before = spark.createDataFrame([("c1", "b", "a", 0.9, DAY, None), ("c2", "c", "d", 0.9, DAY, "keep_a"), ("c5", "a", "e", 0.9, DAY, None)], conflict)
    found = spark.createDataFrame([("a", "b", 0.95, DAY), ("d", "c", 0.91, DAY + dt.timedelta(1)), ("c", "d", 0.97, DAY + dt.timedelta(1)), ("x", "x", 1.0, DAY), (None, "x", 1.0, DAY)], "block_a string, block_b string, similarity double, detected_at timestamp_ntz")
    after = upkeep.conflicts_after(before, found)
    new = rows(after.filter("conflict_id NOT IN ('c1', 'c2', 'c5')"), "block_a", "block_b", "similarity")
    assert after.count() == 4 and new == [("c", "d", 0.97)] and upkeep.conflicts_after(after, found).count() == 4
    nodes = spark.createDataFrame([(x, "active", x.upper(), DAY, 1) for x in "abcde"], "id string, status string, essence string, updated_at timestamp_ntz, `odd.name` int")
    said = spark.createDataFrame([("c1", 1, "merge", None, None), ("c1", 2, "merge", "both", "same"), ("c1", 3, "keep_a", None, ""), ("c2", 1, "keep_a", None, None), ("c5", 1, None, None, None), ("c5", 2, "keep_b", None, None), ("c9", 1, "keep_a", None, None)], "conflict_id string, seq int, said string, merged_essence string, reason string")
    c, n, outcomes = upkeep.resolved(before, nodes, said, now())
    assert rows(outcomes, "conflict_id", "seq", "outcome") == [("c1", 1, "BAD_RESOLUTION"), ("c1", 2, "ok"), ("c1", 3, "NOT_FOUND"), ("c2", 1, "NOT_FOUND"), ("c5", 1, "BAD_RESOLUTION"), ("c5", 2, "ok"), ("c9", 1, "NOT_FOUND")]
    assert rows(c, "conflict_id", "resolution") == [("c1", "merge: same"), ("c2", "keep_a"), ("c5", "keep_b")]
    assert rows(n, "id", "status", "essence", "`odd.name`") == [("a", "archived", "A", 1), ("b", "active", "both", 1), ("c", "active", "C", 1), ("d", "active", "D", 1), ("e", "active", "E", 1)]


def test_merged_items_take_over_references(spark):
    items = spark.createDataFrame([("a", "fact", "Use  TLS ", 1, "g1"), ("b", "fact", "use tls", 2, "g2"), ("c", "task", "use tls", 3, "g1"), ("d", "fact", None, 4, None), ("e", "fact", " ", 5, "g1"), ("f", "fact", "use\ttls", 6, "g1")], "id string, type string, value string, place int, `group` string")
    refs = spark.createDataFrame([("b", "c", "based_on"), ("a", "c", "based_on"), ("b", "a", "based_on"), ("c", "f", "prompted_by"), ("b", "d", "extends"), ("f", "e", "extends"), ("d", "zz", "resolves"), ("no", "a", "based_on")], "source_id string, target_id string, kind string")
    into, links = upkeep.merged_items(items, refs)
    assert rows(into, "id", "into", "copies", "groups") == [("a", "a", 3, ["g1", "g2"]), ("b", "a", 3, ["g1", "g2"]), ("c", "c", 1, ["g1"]), ("d", "d", 1, []), ("e", "e", 1, ["g1"]), ("f", "a", 3, ["g1", "g2"])]
    assert rows(links, "source_id", "kind", "target_id") == [("a", "based_on", "c"), ("a", "extends", "d"), ("c", "prompted_by", "a"), ("d", "resolves", "zz")]
    assert upkeep.merged_items(items.limit(0), refs)[1].count() == 0


def test_links_are_guarded(spark):
    items = spark.createDataFrame([("a", "g1"), ("b", "g2"), ("c", "g1"), ("d", None), ("e", None)], "id string, `group` string")
    links = spark.createDataFrame([("a", "b", "based_on"), ("a", "c", "based_on"), ("a", "a", "based_on"), ("a", "x", "based_on"), (None, "b", "based_on"), ("a", "b", "causes"), ("b", "a", None), ("d", "e", "extends"), ("a", "d", "affects")], "source_id string, target_id string, type string")
    got = {tuple(r)[:3]: r["outcome"] for r in upkeep.guarded(items, links).collect()}
    assert [got[tuple(r)] for r in links.collect()] == ["added", "same_group", "self_link", "unknown_id", "unknown_id", "unknown_type", "unknown_type", "same_group", "added"]


def _claimed(tries, frees, seconds):
    """The same by a loop over time; what frees at a time frees before the attempts of that time."""
    steps = sorted([(at, 0, 0, b, a) for b, a, at in frees] + [(at, 1, seq, b, a) for b, a, at, seq in tries])
    holder, out = {}, {}
    for at, kind, seq, block, agent in steps:
        held = holder.get(block)
        if kind == 0:
            if held and held[0] == agent and held[1] < at:
                del holder[block]
        elif held and at <= held[1] + seconds:
            out[seq] = (False, held[0])
        else:
            holder[block] = (agent, at)
            out[seq] = (True, agent)
    return out


def test_claims_as_by_a_loop(spark):
    rng = random.Random(5)
    # half of all attempts are on one block
    tries = [(0 if rng.random() < 0.5 else rng.randrange(1, 5), rng.choice("xyz"), rng.randrange(900), n) for n in range(500)]
    frees = [(rng.randrange(5), rng.choice("xyz"), rng.randrange(900)) for _ in range(120)]
    time = lambda s: DAY + dt.timedelta(seconds=s)
    attempts = spark.createDataFrame([(b, a, time(t), n) for b, a, t, n in tries] + [(None, "x", DAY, 900), (1, None, DAY, 901), (1, "x", None, 902)], "block int, agent string, at timestamp_ntz, seq int")
    releases = spark.createDataFrame([(b, a, time(t)) for b, a, t in frees] + [(None, None, None)], "block int, agent string, at timestamp_ntz")
    for seconds in (1, 10):
        got = temporal.claims(attempts, releases, seconds).collect()
        assert {r["seq"]: (r["claimed"], r["claimed_by"]) for r in got} == _claimed(tries, frees, seconds) and len(got) == 500
        assert all((r["expires_at"] == r["at"] + dt.timedelta(seconds=seconds)) if r["claimed"] else r["expires_at"] is None for r in got)
    assert temporal.claims(attempts.limit(0), releases, 5).count() == 0 and temporal.claims(attempts, releases.limit(0), 10_000).filter("claimed").count() == 5


def test_next_rows_read_no_group_anew_for_each_row(spark):
    rows = spark.createDataFrame([(n, "k", 10 * n, 0) for n in range(9)] + [(9, "k", 30, -1)], "n bigint, key string, t bigint, order int")
    asks = spark.createDataFrame([(n, "k", 10 * n - 5) for n in range(1, 10)] + [(20, "k", 30), (21, "j", 0)], "n bigint, key string, at bigint")
    got = temporal.next_rows(rows, asks, "key", 25)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 2), (3, 9), *((n, n) for n in range(4, 9)), (20, 9)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan


def test_reminders_by_hand(spark):
    time = lambda s: DAY + dt.timedelta(seconds=s)
    reads = spark.createDataFrame([("a", time(0)), ("a", time(0)), ("a", time(1000)), (None, time(0))], "client string, at timestamp_ntz")
    cases = [("a", "f", -1, "never"), ("b", "f", 5, "never"), ("a", "f", 0, "grace"), ("a", "f", 119, "grace"), ("a", "f", 120, "new_file"), ("a", "f", 121, "seen"), ("a", "g", 121, "new_file"), ("a", None, 130, "no_file"), ("a", "", 131, "no_file"), ("a", "f", 1120, "new_file"), ("a", "g", 2801, "stale"), ("a", "h", 2800, "new_file")]
    edits = spark.createDataFrame([(n, c, f, time(t)) for n, (c, f, t, _) in enumerate(cases)] + [(99, None, "f", DAY), (98, "a", "f", None)], "id int, client string, file string, at timestamp_ntz")
    got = {r["id"]: (r["why"], r["remind"]) for r in temporal.reminders(edits, reads, 1800, 120).collect()}
    assert got == {n: (why, why in ("never", "stale", "new_file")) for n, (*_, why) in enumerate(cases)}


def test_overview_counts_what_hangs_nowhere(spark):
    nodes = spark.createDataFrame([("p", "project", None, DAY, None), ("t", "task", "p", DAY, "open"), ("u", "task", None, DAY, "finished"), ("v", "fact", None, DAY + dt.timedelta(1), None), ("w", "fact", None, DAY, None)], "id string, type string, project_id string, created_at timestamp_ntz, work_status string")
    edges = spark.createDataFrame([("v", "t")], "source_id string, target_id string")
    activity = spark.createDataFrame([("x", DAY), ("x", DAY + dt.timedelta(2)), ("y", DAY)], "agent string, at timestamp_ntz")
    got = rows(reports.overview(nodes, edges, activity, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), 2), "section", "name", "n")
    assert got == sorted([("nodes", "project", 1), ("nodes", "task", 2), ("nodes", "fact", 2), ("projects", "p", None), ("open_tasks", "t", None), ("recent", "v", None), ("recent", "p", None), ("active_agents", "x", 2), ("unlinked", None, 2)], key=repr)


def test_reports_and_upkeep_of_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    cycles = empty("k string, cycle int, billed bigint, lag_ms bigint, limited boolean, limit_pass string")
    writes, recalls = empty("cycle int, type string, quality double, created boolean"), empty("k string, injected bigint, crossed bigint")
    assert reports.session_report(cycles, writes, recalls, "k").count() == 0
    assert reports.pending_extraction(empty("k int, turn int, status string, name string, error string"), "k").count() == 0
    ranges, nodes = empty("k int, range_id string, first int, last int, at timestamp_ntz"), empty("id string, label string, type string, chain_id string")
    assert reports.recent_extractions(ranges, empty("range_id string, id string"), nodes, "k").count() == 0
    graph = empty(NODE + ", essence string, status string, updated_at timestamp_ntz, created_at timestamp_ntz, work_status string")
    links = empty("source_id string, target_id string, type string")
    assert reports.root_tree(graph, links, empty("root_a string, root_b string, total int")).count() == 0
    # the number of loose nodes is told even if it is 0
    assert [tuple(r)[:3] for r in reports.overview(graph, links, empty("agent string, at timestamp_ntz"), now()).collect()] == [("unlinked", None, 0)]
    conflicts = empty("conflict_id string, block_a string, block_b string, similarity double, detected_at timestamp_ntz, resolution string")
    assert upkeep.conflicts_after(conflicts, conflicts.drop("conflict_id", "resolution")).count() == 0
    assert [df.count() for df in upkeep.resolved(conflicts, graph, empty("conflict_id string, seq int, said string, merged_essence string, reason string"), now())] == [0, 0, 0]
    assert upkeep.guarded(empty("id string, `group` string"), links).count() == 0
    assert temporal.reminders(empty("id int, client string, file string, at timestamp_ntz"), empty("client string, at timestamp_ntz"), 10, 1).count() == 0


def test_merged_items_read_each_value_once(spark):
    items = spark.createDataFrame([("a", "fact", "Red  x", 1, "p"), ("b", "fact", "red x", 2, "q"), ("c", "fact", "", 3, None)], "id string, type string, value string, place int, group string")
    refs = spark.createDataFrame([("b", "c", "based_on"), ("c", "b", "extends"), ("a", "b", "based_on")], "source_id string, target_id string, kind string")
    into, links = upkeep.merged_items(items, refs)
    assert rows(links, "source_id", "target_id", "kind") == [("a", "c", "based_on"), ("c", "a", "extends")]
    # neither table works the values out anew
    assert all("sha2" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (into, links))
