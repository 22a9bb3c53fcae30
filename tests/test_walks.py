from __future__ import annotations

import random

import pytest

from threadloom.operators import traverse


def brute(pairs, starts):
    """Fewest hops from each start, breadth first."""
    nexts = {}
    for a, b in pairs:
        nexts.setdefault(a, set()).add(b)
    out = {}
    for s in starts:
        depth, frontier = {s: 0}, [s]
        while frontier:
            frontier = [y for y in {y for x in frontier for y in nexts.get(x, ())} if y not in depth and not depth.update({y: depth[frontier[0]] + 1})]
        out |= {(s, x): d for x, d in depth.items()}
    return out


def graph(seed):
    """Lines that meet, branch and end in rings, loops on a node, edges given twice, rings that nothing leads to."""
    rng = random.Random(seed)
    pairs = []
    for line in range(8):
        ids = [f"l{line}-{k}" for k in range(rng.randint(2, 14))]
        pairs += list(zip(ids, ids[1:], strict=False))
        if line and rng.random() < 0.8:
            pairs.append((ids[-1], rng.choice(pairs)[0]))
        if rng.random() < 0.5:
            pairs.append((rng.choice(pairs)[0], ids[rng.randrange(len(ids))]))
    ring = [f"r{k}" for k in range(7)]
    pairs += [*zip(ring, ring[1:] + ring[:1], strict=True), ("x", "x"), ("y", "z"), ("y", "z"), ("z", "y"), ("in", "r3")][: rng.choice([7, 11, 12])]
    return pairs


@pytest.mark.parametrize("seed", range(4))
def test_walks_equal_breadth_first(spark, seed):
    pairs = graph(seed)
    nodes = sorted({x for p in pairs for x in p})
    starts = random.Random(seed).sample(nodes, 12) + ["nowhere"]
    e = spark.createDataFrame(pairs, "source_id string, target_id string").coalesce(2)
    s = spark.createDataFrame([(x,) for x in starts], "start string")
    got = [((r.start, r.id), r.depth) for r in traverse.walk(e, s, True).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(pairs, starts)
    if seed < 2:
        up, down = traverse.both_lines(e)
        assert {(r.start, r.id): r.depth for r in traverse.walk(e, s, False, line=down).collect()} == brute([(b, a) for a, b in pairs], starts)
        assert {(r.start, r.id): r.depth for r in traverse.walk(e, s, True, 3).collect()} == {k: d for k, d in brute(pairs, starts).items() if d <= 3}
    few = starts[:3]
    found = [r.id for r in traverse.reached(e, spark.createDataFrame([(x,) for x in few], "id string")).collect()]
    assert len(found) == len(set(found)) and set(found) == {x for _, x in brute(pairs, few)}


def test_rounds_grow_with_the_logarithm_of_a_line(spark, monkeypatch):
    """A line of 2,000 nodes in under 15 rounds."""
    rounds = []
    real = traverse.settled_counted
    monkeypatch.setattr(traverse, "settled_counted", lambda *a: rounds.append(1) or real(*a))
    e = spark.createDataFrame([(k, k - 1) for k in range(1, 2000)], "source_id int, target_id int").coalesce(2)
    starts = spark.createDataFrame([(1999,), (7,)], "start int")
    got = {(r.start, r.id): r.depth for r in traverse.walk(e, starts, True).collect()}
    assert got == {(1999, k): 1999 - k for k in range(2000)} | {(7, k): 7 - k for k in range(8)} and len(rounds) < 15
    rounds.clear()
    assert traverse.reached(e, starts.withColumnRenamed("start", "id")).count() == 2000 and len(rounds) < 15


def test_components_of_blocks_are_one_round(spark, monkeypatch):
    """Edges that lie together are connected where they lie; blocks that share nodes, in any order, give the same components."""
    rounds = []
    real = traverse.settled_counted
    monkeypatch.setattr(traverse, "settled_counted", lambda *a: rounds.append(1) or real(*a))
    pairs = [(f"{c}-{k:03}", f"{c}-{k // 2:03}") for c in "abc" for k in range(60)] + [("x", "x")]
    want = {x: f"{x[0]}-000" for p in pairs for x in p if x != "x"}
    e = spark.createDataFrame(pairs, "source_id string, target_id string").coalesce(1)
    assert {r.id: r.component for r in traverse.components(e).collect()} == want and len(rounds) == 1
    assert {r.id: r.component for r in traverse.components(e.repartition(7)).collect()} == want
    cut = traverse.stars(e.selectExpr("source_id AS u", "target_id AS v").filter("u <> v"), 5)
    assert cut.select("id").distinct().count() < cut.count()


@pytest.mark.parametrize("near", [20_000, 6])
def test_members_equal_breadth_first(spark, monkeypatch, near):
    """Threads of small components in one task, of wide ones in rounds; both as by hand."""
    monkeypatch.setattr(traverse, "NEAR", near)
    rounds = []
    real = traverse.settled_counted
    monkeypatch.setattr(traverse, "settled_counted", lambda *a: rounds.append(1) or real(*a))
    pairs = graph(1) + [("m", "n"), ("s", "s")]
    starts = [*random.Random(1).sample(sorted({x for p in pairs for x in p}), 9), "m", "s", "nowhere"]
    want = {}
    for s in starts:
        depth = {x: d for (_, x), d in brute([(b, a) for a, b in pairs], [s]).items()} | {x: -d for (_, x), d in brute(pairs, [s]).items()}
        for x, d in depth.items():
            want[s, x] = (d, not any(a == x and b in depth for a, b in pairs), not any(b == x and a in depth for a, b in pairs))
    e = spark.createDataFrame(pairs, "source_id string, target_id string").coalesce(2)
    got = traverse.members(e, spark.createDataFrame([(x,) for x in starts], "start string")).collect()
    assert {(r.start, r.id): (r.depth, r.is_origin, r.is_leaf) for r in got} == want and len(got) == len(want)
    assert near == 6 or len(rounds) < 8
