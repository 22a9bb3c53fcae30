"""Containment and causal traversal.

Edges point from the effect (source_id) to the cause (target_id). Walks go round by round: a join of the frontier with the
edges, in which lines are single hops, less what has been reached as soon. Every round is a stored table, so plans stay short
at any depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.checkpoints import grown, settled, settled_counted

if TYPE_CHECKING:
    import pyarrow as pa

#: Which edges order a thread, which bridge threads and how strongly, and how conclusive a node type is.
SPINE = ("prompted_by", "based_on", "extends", "supersedes", "derived_from", "resolves")
BRIDGES = {"contradicts": 4, "supports": 3, "affects": 2, "related_to": 1}
CONCLUSIVE = {"dead_end": 5, "constraint": 5, "decision": 4, "blueprint": 4, "insight": 3, "question": 3}

#: What kind of relatedness an edge between two roots shows, and which edges put their source under their target.
CATEGORIES = {
    "based_on": "dependency", "prompted_by": "dependency", "derived_from": "dependency", "supports": "dependency", "extends": "dependency",
    "depends_on": "dependency", "affects": "dependency", "affected_by": "dependency", "triggered": "dependency", "enables": "dependency",
    "part_of": "containment", "contains": "containment", "supersedes": "evolution", "superseded_by": "evolution",
    "contradicts": "conflict", "related_to": "loose",
}
SUBORDINATING = ("based_on", "prompted_by", "derived_from", "depends_on", "part_of", "triggered", "affected_by")

#: About how many nodes are connected at once in a task, and up to how many edges, and edges times starts, a component is walked in one.
BLOCK = 200_000
NEAR, NEAR_STEPS = 20_000, 4_000_000


def lookup(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def root_relatedness(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of roots with the edges between them by category, and roots that have none.

    A node's root is itself if it is a project, else its project. Edges are summed by root and target before the second
    join. The parent is the root that most subordinating edges point to, of equals the smaller id; none without such edges.
    """
    root = F.when(F.col("type") == "project", F.col("id")).otherwise(F.col("project_id"))
    of = nodes.select("id", root.alias("root")).filter("root IS NOT NULL")
    kinds = edges.withColumn("category", lookup(CATEGORIES)[F.col("type")]).filter("category IS NOT NULL")
    kinds = kinds.withColumn("under", F.col("type").isin(*SUBORDINATING).cast("bigint"))
    first = kinds.join(of.select(F.col("id").alias("source_id"), F.col("root").alias("from_root")), "source_id")
    first = first.groupBy("from_root", "target_id", "category", "under").agg(F.count("*").alias("n"))
    both = first.join(of.select(F.col("id").alias("target_id"), F.col("root").alias("to_root")), "target_id").filter("from_root <> to_root")
    paired = both.withColumn("root_a", F.least("from_root", "to_root")).withColumn("root_b", F.greatest("from_root", "to_root"))
    n, under = F.col("n"), F.col("n") * F.col("under")
    sums = paired.groupBy("root_a", "root_b").agg(
        *(F.sum(F.when(F.col("category") == c, n).otherwise(0)).alias(c) for c in ("dependency", "containment", "evolution", "conflict", "loose")),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("to_root") == F.col("root_a"), under).otherwise(0)).alias("to_a"),
        F.sum(F.when(F.col("to_root") == F.col("root_b"), under).otherwise(0)).alias("to_b"),
    )
    parent = F.when(F.greatest("to_a", "to_b") == 0, F.lit(None)).when(F.col("to_a") >= F.col("to_b"), F.col("root_a")).otherwise(F.col("root_b"))
    pairs = sums.select("root_a", "root_b", "dependency", "containment", "evolution", "conflict", "loose", "total", parent.alias("parent"), F.greatest("to_a", "to_b").alias("parent_edges"))
    related = pairs.select(F.explode(F.array("root_a", "root_b")).alias("id")).distinct()
    alone = nodes.filter("type = 'project'").select("id").join(related, "id", "left_anti")
    return pairs, alone


def uncycled(parent: DataFrame) -> DataFrame:
    """Parents (at, up) without that of the smallest id of each cycle; paths double in length each round."""
    n, length = parent.count(), 1
    path = settled(parent.withColumn("least", F.col("at")))
    while length <= n and not path.isEmpty():
        far = path.select(F.col("at").alias("up"), F.col("up").alias("next"), F.col("least").alias("then"))
        path = settled(path.join(far, "up").select("at", F.col("next").alias("up"), F.least("least", "then").alias("least")))
        length *= 2
    on = path.select(F.col("up").alias("at")).distinct()
    return parent.join(path.join(on, "at", "left_semi").filter("at = least").select("at"), "at", "left_anti")


def top_roots(roots: DataFrame, levels: int | None = None) -> DataFrame:
    """Each project's topmost project and how far up it is, to any depth unless levels are given.

    Projects whose parent is unknown are topmost; of a cycle, the smallest id is.
    """
    parent = settled(roots.select(F.col("id").alias("at"), F.col("project_id").alias("up")))
    known = parent.select(F.col("at").alias("up")).distinct()
    parent = settled(parent.join(known, "up", "left_semi").select("at", "up"))
    parent = settled(uncycled(parent))
    found = roots.select("id", F.col("id").alias("at"), F.lit(0).cast("bigint").alias("up_levels"))
    level = 0
    while levels is None or level < levels:
        step = settled(found.join(parent, "at", "left").select("id", F.coalesce("up", "at").alias("at"), (F.col("up_levels") + F.col("up").isNotNull().cast("bigint")).alias("up_levels"), F.col("up").isNotNull().alias("moved")))
        found = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
        level += 1
    return found.select("id", F.col("at").alias("top"), "up_levels")


def scope_chains(blocks: DataFrame, containment: DataFrame, containers: DataFrame, most: int = 8) -> DataFrame:
    """id and scope: the labels of what contains each block (id, label) and its own, topmost first, most at most.

    Of several containers the smallest id counts; one that is unknown ends the chain, and so does the most on cycles.
    """
    names = containers.select(F.col("id").alias("next"), F.col("label").alias("next_label"))
    up = settled(containment.groupBy(F.col("source_id").alias("at")).agg(F.min("target_id").alias("next")).join(names, "next"))
    found = blocks.select("id", F.col("id").alias("at"), F.col("label").alias("scope"))
    done: list[DataFrame] = []
    for _ in range(most - 1):
        step = settled(found.join(up, "at", "left"))
        done.append(step.filter("next IS NULL").select("id", "scope"))
        found = step.filter("next IS NOT NULL").select("id", F.col("next").alias("at"), F.concat_ws(" > ", "next_label", "scope").alias("scope"))
        if found.isEmpty():
            break
    return reduce(DataFrame.unionByName, done, found.select("id", "scope"))


def runs(hops: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """Nodes with one hop in and one out that lie on a line: id, run (the line's last such node), after (where it leads) and d (hops to there).

    hops: id, next. Pointers along a line double in length twice a round, so rounds grow with the logarithm of its length. A ring
    of such nodes has no end: its smallest id is taken for one. breaks are nodes that are never on a line. Stored.
    """
    one_out = hops.groupBy("id").agg(F.first("next").alias("next"), F.count("*").alias("n")).filter("n = 1 AND id <> next").select("id", "next")
    one_in = hops.groupBy(F.col("next").alias("id")).agg(F.count("*").alias("n")).filter("n = 1").select("id")
    inner = one_out.join(one_in, "id")
    inner, n = settled_counted(inner if breaks is None else inner.join(breaks, "id", "left_anti"))
    # run: the farthest inner node found so far, next: what follows it
    found = inner.select("id", F.col("id").alias("run"), F.col("next").alias("after"), F.lit(1).cast("bigint").alias("d"), F.col("id").alias("least"))
    inside = found.select(F.col("id").alias("after"), F.lit(True).alias("on")).distinct()
    found, open_ = settled_counted(found.join(inside, "after", "left").select("id", "run", "after", "d", "least", F.coalesce("on", F.lit(False)).alias("on")), "on")

    def doubled(f: DataFrame) -> DataFrame:
        far = f.select(F.col("id").alias("after"), F.col("run").alias("run2"), F.col("after").alias("after2"), F.col("d").alias("d2"), F.col("least").alias("least2"), F.col("on").alias("on2"))
        on = lambda there, here: F.when(F.col("on"), F.col(there)).otherwise(here)
        return f.join(far, "after", "left").select(
            "id", on("run2", F.col("run")).alias("run"), on("after2", F.col("after")).alias("after"), (F.col("d") + on("d2", F.lit(0))).alias("d"), F.least("least", on("least2", F.lit(None))).alias("least"), (F.col("on") & F.coalesce("on2", F.lit(False))).alias("on")
        )

    length = 1
    while open_ and length <= 2 * n:
        found, open_ = settled_counted(doubled(doubled(found)), "on")
        length *= 4
    if open_:
        rings = found.filter("on").select(F.col("least").alias("id")).distinct()
        return runs(hops, settled(rings if breaks is None else rings.unionByName(breaks)))
    return found.select("id", "run", "after", "d")


def turned(line: DataFrame, hops: DataFrame) -> DataFrame:
    """The lines of runs(hops) for the hops turned round: what was before a line's first node is after its last."""
    size = line.groupBy("run").agg(F.max("d").alias("size"), F.max_by("id", "d").alias("next"))
    before = hops.join(size, "next").select("run", "size", F.col("id").alias("after"))
    return settled(line.select("id", "run", "d").join(before, "run").select("id", "run", "after", (F.col("size") + 1 - F.col("d")).alias("d")))


def walk(edges: DataFrame, starts: DataFrame, upwards: bool, levels: int | None = None, line: DataFrame | None = None) -> DataFrame:
    """Nodes reached from starts (start): start, id, depth (the fewest edges), towards causes or effects; starts at 0.

    Goes on until nothing new is reached, unless levels are given. Without levels lines of nodes with one cause and one effect
    are single hops of their length, so rounds don't grow with the length of a line; shorter ways found later replace longer.
    line are these lines, if they are known.
    """
    a, b = ("source_id", "target_id") if upwards else ("target_id", "source_id")
    hops = settled(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct())
    if levels is not None:
        return stepped(hops, starts, levels)
    line = runs(hops) if line is None else line
    on = line.select("id")
    # where a hop into a line leads, and the line's members as seen from its first node
    into = hops.join(on, "id", "left_anti").join(line.select(F.col("id").alias("next"), "run", "after", "d"), "next", "left")
    wide = settled(into.groupBy("id", F.coalesce("after", "next").alias("next"), "run").agg(F.min(F.coalesce("d", F.lit(0)) + 1).alias("length")))
    begin = starts.select("start").distinct().join(line.select(F.col("id").alias("start"), "run", "after", "d"), "start", "left")
    begin = settled(begin)
    frontier = begin.select("start", F.coalesce("after", "start").alias("id"), F.coalesce("d", F.lit(0)).cast("bigint").alias("depth"))
    frontier, more = settled_counted(frontier)
    parts: list[tuple[int, DataFrame]] = []
    seen = grown(parts, frontier)
    while more:
        step = frontier.join(wide, "id").groupBy("start", F.col("next").alias("id")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        known = seen.groupBy("start", "id").agg(F.min("depth").alias("known"))
        frontier, more = settled_counted(step.join(known, ["start", "id"], "left").filter("known IS NULL OR depth < known").select("start", "id", "depth"))
        if more:
            seen = grown(parts, frontier)
    ends = seen.groupBy("start", "id").agg(F.min("depth").alias("depth"))
    entered = ends.join(wide.filter("run IS NOT NULL").select("id", "run", "length"), "id").groupBy("start", "run").agg(F.min(F.col("depth") + F.col("length")).alias("to_end"))
    own = begin.filter("run IS NOT NULL").select("start", "run", F.col("d").alias("to_end"))
    # from the end of a line back to each member that is passed
    passed = entered.unionByName(own).join(line.select("id", "run", "d"), "run").filter("d <= to_end").select("start", "id", (F.col("to_end") - F.col("d")).alias("depth"))
    every = ends.unionByName(passed).unionByName(starts.select("start", F.col("start").alias("id"), F.lit(0).cast("bigint").alias("depth")))
    return every.groupBy("start", "id").agg(F.min("depth").cast("bigint").alias("depth"))


def both_lines(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of a walk towards causes and of one towards effects: they are the same, ranked once."""
    hops = settled(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).distinct())
    line = runs(hops)
    return line, turned(line, hops)


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """ids of starts (id) and of all that they lead to over edges from source to target; lines are single hops, as in walk()."""
    hops = settled(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).distinct())
    line = runs(hops)
    into = hops.join(line.select("id"), "id", "left_anti").join(line.select(F.col("id").alias("next"), "run", "after"), "next", "left")
    wide = settled(into.select("id", F.coalesce("after", "next").alias("next"), "run").distinct())
    begin = settled(starts.select("id").distinct().join(line, "id", "left"))
    frontier, more = settled_counted(begin.select(F.coalesce("after", "id").alias("id")).distinct())
    parts: list[tuple[int, DataFrame]] = []
    seen = grown(parts, frontier)
    while more:
        frontier, more = settled_counted(frontier.join(wide, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"))
        if more:
            seen = grown(parts, frontier)
    whole = wide.filter("run IS NOT NULL").join(seen, "id", "left_semi").select("run").distinct()
    own = begin.filter("run IS NOT NULL").groupBy("run").agg(F.max("d").alias("from"))
    passed = line.join(whole, "run", "left_semi").select("id").unionByName(line.join(own, "run").filter("d <= from").select("id"))
    return seen.unionByName(passed).unionByName(begin.select("id")).distinct()


def stepped(hops: DataFrame, starts: DataFrame, levels: int) -> DataFrame:
    """walk() edge by edge for so many levels."""
    frontier = settled(starts.select("start", F.col("start").alias("id"), F.lit(0).cast("bigint").alias("depth")))
    parts: list[tuple[int, DataFrame]] = []
    seen = grown(parts, frontier)
    for depth in range(1, levels + 1):
        step = frontier.join(hops, "id").select("start", F.col("next").alias("id")).distinct()
        frontier, more = settled_counted(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if not more:
            break
        seen = grown(parts, frontier)
    return seen


def members(edges: DataFrame, starts: DataFrame, levels: int | None = None, comps: DataFrame | None = None) -> DataFrame:
    """The thread of each start: start, id, depth (causes below 0, effects above), is_origin and is_leaf. Stored.

    Causes are walked first; what both walks reach counts as a cause. Origins have no cause, leaves no effect in the thread.
    Without levels, the edges of a component that has starts are walked in one task; components of more than NEAR edges, or
    NEAR_STEPS edges times starts, round by round. comps are the components of the edges, where they are known already.
    """
    if levels is not None:
        return settled(far_members(edges, starts, levels))
    comps = components(edges) if comps is None else comps
    own = starts.select("start").distinct().join(comps.withColumnRenamed("id", "start"), "start", "left")
    own = settled(own.select(F.coalesce("component", "start").alias("component"), "start"))
    asked = comps.join(own.select("component").distinct(), "component", "left_semi")
    # a node with no edge but to itself, or to none, is in no component
    loops = edges.filter(~F.coalesce(F.col("source_id") != F.col("target_id"), F.lit(False))).select(F.coalesce("source_id", "target_id").alias("id"))
    loops = loops.distinct().join(own.filter("component = start").select(F.col("start").alias("id")), "id", "left_semi").withColumn("component", F.col("id"))
    asked = asked.select("id", "component").unionByName(loops.join(asked.select("id"), "id", "left_anti"))
    placed = edges.select("source_id", "target_id", F.coalesce("source_id", "target_id").alias("id")).join(asked, "id").select("component", "source_id", "target_id")
    placed = settled(placed)
    size = placed.groupBy("component").agg(F.count("*").alias("n")).join(own.groupBy("component").agg(F.count("*").alias("starts")), "component")
    wide, some = settled_counted(size.filter((F.col("n") > NEAR) | (F.col("n") * F.col("starts") > NEAR_STEPS)).select("component"))
    if not some:
        return settled(near_members(placed, own))
    near = near_members(placed.join(wide, "component", "left_anti"), own.join(wide, "component", "left_anti"))
    far = far_members(placed.join(wide, "component", "left_semi").select("source_id", "target_id"), own.join(wide, "component", "left_semi").select("start"))
    return settled(near.unionByName(far))


def near_members(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """members() of starts (component, start) over edges (component, source_id, target_id), each component in one task."""
    kind = edges.schema["source_id"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    rows = edges.select("component", "source_id", "target_id", none.alias("start")).unionByName(starts.select("component", none.alias("source_id"), none.alias("target_id"), "start"))

    def reach(nexts: dict, start: object) -> dict:
        depth, frontier, d = {start: 0}, [start], 0
        while frontier:
            d, found = d + 1, []
            for x in frontier:
                for y in nexts.get(x, ()):
                    if y not in depth:
                        depth[y] = d
                        found.append(y)
            frontier = found
        return depth

    def threads(edges: list, starts: list) -> Iterator[tuple]:
        causes, effects = {}, {}
        for a, b in edges:
            # an edge without an end leads to no node further on
            if a is not None:
                causes.setdefault(a, set()).add(b)
            if b is not None:
                effects.setdefault(b, set()).add(a)
        for s in starts:
            depth = {x: -d for x, d in reach(causes, s).items()}
            depth = reach(effects, s) | depth
            for x, d in depth.items():
                of = lambda nexts: any(y is not None and y in depth for y in nexts.get(x, ()))  # noqa: B023, E731
                yield s, x, d, not of(causes), not of(effects)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        at, held, begun, out = None, [], [], []
        ids = None

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            kinds = (ids, ids, pa.int64(), pa.bool_(), pa.bool_())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["start", "id", "depth", "is_origin", "is_leaf"])
            out.clear()
            return batch

        def closed() -> Iterator[pa.RecordBatch]:
            for row in threads(held, begun):
                out.append(row)
                if len(out) == 10_000:
                    yield told()
            held.clear()
            begun.clear()

        for batch in batches:
            ids = batch.schema.field(1).type
            for component, a, b, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != at:
                    yield from closed()
                    at = component
                if start is None:
                    held.append((a, b))
                else:
                    begun.append(start)
        yield from closed()
        if out:
            yield told()

    return rows.repartition("component").sortWithinPartitions("component").mapInArrow(walked, f"start {kind}, id {kind}, depth bigint, is_origin boolean, is_leaf boolean")


def far_members(edges: DataFrame, starts: DataFrame, levels: int | None = None) -> DataFrame:
    """members() round by round."""
    lines = both_lines(edges) if levels is None else (None, None)
    up = walk(edges, starts, True, levels, lines[0]).select("start", "id", (-F.col("depth")).alias("depth"))
    down = walk(edges, starts, False, levels, lines[1]).join(up.select("start", "id"), ["start", "id"], "left_anti")
    found = settled(up.unionByName(down))
    e = edges.select("source_id", "target_id").distinct()
    inner = e.join(found.select("start", F.col("id").alias("source_id")), "source_id").join(found.select("start", F.col("id").alias("target_id")), ["start", "target_id"])
    has_cause = inner.select("start", F.col("source_id").alias("id"), F.lit(True).alias("has_cause")).distinct()
    has_effect = inner.select("start", F.col("target_id").alias("id"), F.lit(True).alias("has_effect")).distinct()
    return found.join(has_cause, ["start", "id"], "left").join(has_effect, ["start", "id"], "left").select("start", "id", "depth", F.col("has_cause").isNull().alias("is_origin"), F.col("has_effect").isNull().alias("is_leaf"))


def thread(edges: DataFrame, starts: DataFrame, levels: int | None = None) -> DataFrame:
    """The members of each thread and the role of each: focal, else origin, else leaf, else step."""
    role = F.when(F.col("depth") == 0, "focal").when(F.col("is_origin"), "origin").when(F.col("is_leaf"), "leaf").otherwise("step")
    return members(edges, starts, levels).select("start", "id", "depth", role.alias("role"))


def stars(edges: DataFrame, most: int = BLOCK) -> DataFrame:
    """id and root of every end of an edge (u, v): the smallest id that edges of its block connect it with.

    A block is as many edges of a partition as have so many ends; a node has a row for each block that it is in.
    """
    kind = edges.schema["u"].dataType.simpleString()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        up: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def told() -> pa.RecordBatch:
            ids = list(up)
            return pa.RecordBatch.from_arrays([pa.array(ids, ids_are), pa.array([root(x) for x in ids], ids_are)], ["id", "root"])

        for batch in batches:
            ids_are = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
                if len(up) >= most:
                    yield told()
                    up.clear()
        if up:
            yield told()

    return edges.select("u", "v").mapInArrow(linked, f"id {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of an edge, in any direction. Stored.

    Blocks of edges are connected where they lie; then only the roots of nodes that are in several blocks are left to connect.
    Where edges of a component lie near each other, that is little; where they don't, it is the graph itself.
    """
    roots = stars(edges.select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).filter("u <> v"))
    nodes = settled(roots.groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots")))
    left = nodes.filter("size(roots) > 1").select(F.col("roots")[0].alias("v"), F.explode(F.slice("roots", 2, F.size("roots"))).alias("u"))
    joined = contracted(left)
    found = nodes.select("id", F.col("roots")[0].alias("root")).join(joined.select(F.col("id").alias("root"), "component"), "root", "left")
    return settled(found.select("id", F.coalesce("component", "root").alias("component")))


def contracted(edges: DataFrame) -> DataFrame:
    """components() of edges (u, v), v < u, round by round.

    Each round, every node points at its smallest neighbour if that is smaller, pointers are followed to their ends two steps
    at once, and nodes are replaced by those; at least half of the nodes that have an edge left go with each round.
    """
    e, left = settled_counted(edges.select("u", "v").distinct())
    found = None
    while left:
        ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        points, moved = settled(ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))), 1
        while moved:
            to = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
            far = to.join(to.select(F.col("p").alias("q"), F.col("q").alias("r")), "q").select("p", "r")
            points, moved = settled_counted(points.join(far, "p").select("u", F.col("r").alias("p"), (F.col("p") != F.col("r")).alias("moved")), "moved")
            points = points.select("u", "p")
        here = points.select(F.col("u").alias("component"), "p")
        found = settled(points.select(F.col("u").alias("id"), F.col("p").alias("component")) if found is None else found.join(here, "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        a, b = points.select("u", F.col("p").alias("pu")), points.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e, left = settled_counted(e.join(a, "u").join(b, "v").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).filter("u <> v").distinct())
    return found if found is not None else e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def inner_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between members (chain, id, created_at) of one chain: chain, source_id, target_id, and whether the effect is not after its cause. Stored."""
    # null times come last
    order = F.struct(F.col("created_at").isNull().alias("none"), "created_at", "id")
    ends = lambda c, o: members.select("chain", F.col("id").alias(c), order.alias(o))
    inner = edges.select("source_id", "target_id").distinct().join(ends("source_id", "effect"), "source_id").join(ends("target_id", "cause"), ["chain", "target_id"])
    return settled(inner.select("chain", "source_id", "target_id", (F.col("effect") <= F.col("cause")).alias("late")))


def causal_order(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Place of every member in its chain (chain, id, created_at), causes first; of several that could follow, the oldest.

    What lies on a cycle comes last, by time. A chain in which all causes are before their effects is in order by time; only others are
    put in order edge by edge, each in one task; chains are threads of one project, not a growing share of the data.
    """
    # a member that is named twice has one place, that of its last time
    members = settled(members.groupBy("chain", "id").agg(F.max("created_at").alias("created_at")))
    inner = inner_edges(members, edges)
    late = settled(inner.filter("late").select("chain").distinct())
    by_time = Window.partitionBy("chain").orderBy(F.asc_nulls_last("created_at"), "id")
    timely = members.select("chain", "id", "created_at").join(late, "chain", "left_anti").select("chain", "id", F.row_number().over(by_time).cast("bigint").alias("place"))
    causes = inner.join(late, "chain", "left_semi").groupBy("chain", F.col("source_id").alias("id")).agg(F.collect_set("target_id").alias("causes"))
    rows = members.select("chain", "id", "created_at").join(late, "chain", "left_semi").join(causes, ["chain", "id"], "left")

    def order(batches: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        import heapq

        g = batches.sort_values(["created_at", "id"]).reset_index(drop=True)
        at = {x: k for k, x in enumerate(g["id"])}
        waiting, effects = {}, {x: [] for x in at}
        for x, cs in zip(g["id"], g["causes"], strict=True):
            cs = list(cs) if cs is not None else []
            waiting[x] = len(cs)
            for c in cs:
                effects[c].append(x)
        ready = [k for x, k in at.items() if not waiting[x]]
        heapq.heapify(ready)
        done: list[int] = []
        while ready:
            k = heapq.heappop(ready)
            done.append(k)
            for x in effects[g["id"][k]]:
                waiting[x] -= 1
                if not waiting[x]:
                    heapq.heappush(ready, at[x])
        done += [k for x, k in at.items() if waiting[x] > 0]
        return pd.DataFrame({"chain": g["chain"][done].values, "id": g["id"][done].values, "place": range(1, len(done) + 1)})

    return timely.unionByName(rows.groupBy("chain").applyInPandas(order, "chain string, id string, place bigint"))


def chains(nodes: DataFrame, edges: DataFrame, conclusive: tuple[str, ...] = tuple(CONCLUSIVE), comps: DataFrame | None = None) -> DataFrame:
    """Components that end in a conclusion: chain, members, terminal and its type.

    An end is a member that causes nothing in the component; of several conclusive ends the weightiest, then the smallest
    id, is the terminal. Components without one give no row. comps are the components, where they are known already.
    """
    comps = components(edges) if comps is None else comps
    members = comps.join(nodes.select("id", "type"), "id")
    causes = edges.select(F.col("target_id").alias("id")).distinct()
    weight = lookup(CONCLUSIVE)[F.col("type")]
    ends = members.join(causes, "id", "left_anti").filter(F.col("type").isin(*conclusive))
    terminal = ends.groupBy("component").agg(F.min(F.struct((-weight).alias("w"), F.col("id"), F.col("type"))).alias("t"))
    size = members.groupBy("component").agg(F.count("*").alias("members"))
    return terminal.join(size, "component").select(F.col("component").alias("chain"), "members", F.col("t.id").alias("terminal"), F.col("t.type").alias("terminal_type"))


def challenges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Who contradicts each node: directly, or a neighbour of it over any other edge; id, challenger and how near."""
    against = edges.filter(F.col("type").isin("contradicts", "challenges")).select(F.col("target_id").alias("id"), F.col("source_id").alias("challenger")).distinct()
    direct = against.withColumn("hops", F.lit(1).cast("bigint"))
    near = edges.filter(~F.col("type").isin("contradicts", "challenges")).select(F.col("source_id").alias("id"), F.col("target_id").alias("n")).distinct()
    second = near.join(against.withColumnRenamed("id", "n"), "n").select("id", "challenger").distinct().withColumn("hops", F.lit(2).cast("bigint"))
    found = direct.unionByName(second).groupBy("id", "challenger").agg(F.min("hops").alias("hops"))
    return found.join(nodes.select("id"), "id", "left_semi")
