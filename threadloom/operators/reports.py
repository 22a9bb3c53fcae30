"""Reports over many projects or sessions at once: scoped counts with disclosure, roots, briefings, sessions, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import scope_segment
from ..sources.checkpoints import settled
from .audit import work_status
from .reads import top_in_group

#: Words for a task that is closed.
CLOSED = ("done", "completed", "archived")
#: Sections of a briefing with a limit, and their limits.
SECTION_LIMITS = {"derived": 5, "other": 10}


def label_scopes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of nodes whose label begins with a root's label and an underscore.

    A label is looked up by each of its prefixes that end before an underscore, so that it meets only the roots it names.
    Nodes without a label are in no scope.
    """
    parts = F.split("label", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    found = nodes.filter(F.contains("label", F.lit("_"))).select("id", F.explode(prefixes).alias("prefix"))
    return found.join(roots.select(F.col("id").alias("root"), F.col("label").alias("prefix")), "prefix").select("root", "id")


def disclosed(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """For every project and kind: how many nodes are its own, and how many more its sub-roots and entangled roots have.

    nodes (id, label, type, project_id) are those that count, edges (source_id, target_id, type) those that hold. A project's scope is itself,
    its members and what its label is a prefix of. Sub-roots are part of it by an edge; entangled roots are others that an
    edge leads to from its scope or back. Their nodes count unless the scope has them already. Rows: root, kind, place
    (own, sub_root, entangled), other (null for own) and n, which is above 0 except for own. Without projects there are no rows.
    """
    roots = nodes.filter("type = 'project'").select("id", "label")
    rid = roots.select(F.col("id").alias("project_id"))
    belongs = nodes.filter("project_id IS NOT NULL").join(rid, "project_id", "left_semi").select(F.col("project_id").alias("root"), "id")
    # stored, as five branches below read it
    members = settled(belongs.unionByName(label_scopes(nodes, roots)).distinct())
    scope = members.unionByName(roots.select(F.col("id").alias("root"), "id")).distinct()
    home = belongs.join(roots.select("id"), "id", "left_anti").unionByName(roots.select(F.col("id").alias("root"), "id"))

    there, back = F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("far")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("far"))
    ends = edges.select(F.inline(F.array(there, back)))
    led = ends.join(home.select(F.col("id").alias("far"), F.col("root").alias("other")), "far").select("id", "other").distinct()
    near = led.join(scope, "id").filter("other <> root").select("root", "other").distinct()
    subs = edges.filter("type = 'part_of'").select(F.col("source_id").alias("other"), F.col("target_id").alias("root")).filter("other <> root")
    subs = subs.join(roots.select(F.col("id").alias("other")), "other", "left_semi").join(roots.select(F.col("id").alias("root")), "root", "left_semi").distinct()
    places = subs.withColumn("place", F.lit("sub_root")).unionByName(near.join(subs, ["root", "other"], "left_anti").withColumn("place", F.lit("entangled")))

    typed = nodes.filter(F.col("type").isin(*kinds)).select("id", F.col("type").alias("kind"))
    counted = typed.join(members, "id")
    all_of = counted.groupBy(F.col("root").alias("other"), "kind").agg(F.count("*").alias("all"))
    # a node has as many scopes as it has prefixes, and one more, so few pairs of them
    shared = counted.withColumnRenamed("root", "other").join(scope, "id").filter("other <> root").groupBy("root", "other", "kind").agg(F.count("*").alias("shared"))
    beyond = places.join(all_of, "other").join(shared, ["root", "other", "kind"], "left").select("root", "kind", "place", "other", (F.col("all") - F.coalesce("shared", F.lit(0))).alias("n"))
    own = typed.join(scope, "id").groupBy("root", "kind").agg(F.count("*").alias("n"))
    asked = roots.select(F.col("id").alias("root"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    own = asked.join(own, ["root", "kind"], "left").select("root", "kind", F.lit("own").alias("place"), F.lit(None).cast("string").alias("other"), F.coalesce("n", F.lit(0)).alias("n"))
    return own.unionByName(beyond.filter("n > 0"))


def root_tree(nodes: DataFrame, part_of: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """Projects with their size, parent, child roots and the most entangled other roots; top ones first, then the largest.

    The parent is the smallest other project that a part_of edge leads to, else the one in the column if that is a project. Child roots
    are the labels of a project's children, sorted; a project has one row, as long as its children. Of equally entangled roots the first by label
    comes first. pairs (root_a, root_b, total) are root_relatedness's.
    """
    roots = nodes.filter("type = 'project'").select("id", "label", "essence", "project_id")
    named = roots.select(F.col("id").alias("up"), F.col("label").alias("parent_root"))
    by_edge = part_of.select(F.col("source_id").alias("id"), F.col("target_id").alias("up")).filter("id <> up").join(named.select("up"), "up", "left_semi").groupBy("id").agg(F.min("up").alias("by_edge"))
    placed = roots.join(by_edge, "id", "left").withColumn("up", F.coalesce("by_edge", F.when(F.col("project_id") != F.col("id"), F.col("project_id")))).join(named, "up", "left")
    children = placed.filter("parent_root IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.array_sort(F.collect_list("label")).alias("child_roots"))
    size = nodes.filter("project_id IS NOT NULL").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("blocks"))
    sides = pairs.select(F.col("root_a").alias("id"), F.col("root_b").alias("up"), "total").unionByName(pairs.select(F.col("root_b").alias("id"), F.col("root_a").alias("up"), "total"))
    best = top_in_group(sides.join(named, "up"), ["id"], [F.desc("total"), F.col("parent_root"), F.col("up")], most)
    best = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parent_root"))), lambda x: x["parent_root"]).alias("entangled_with"))
    none = F.array().cast("array<string>")
    listed = placed.join(size, "id", "left").join(children, "id", "left").join(best, "id", "left")
    listed = listed.select("id", "label", F.col("essence").alias("description"), F.coalesce("blocks", F.lit(0)).alias("blocks"), "parent_root", F.coalesce("child_roots", none).alias("child_roots"), F.coalesce("entangled_with", none).alias("entangled_with"))
    return listed.orderBy(F.col("parent_root").isNotNull(), F.desc("blocks"), "label", "id")


def _section() -> Column:
    kind = F.col("type")
    open_ = ~F.lower(F.coalesce("work_status", F.lit(""))).isin(*CLOSED)
    return F.filter(
        F.array(
            F.when((kind == "task") & open_, "open_tasks"),
            F.when(kind == "decision", "decisions"),
            F.when(kind == "constraint", "constraints"),
            F.when(F.col("derived"), "derived"),
            F.when(~kind.isin("task", "decision", "constraint", "project") & ~F.col("derived"), "other"),
        ),
        lambda s: s.isNotNull(),
    )


def briefing(nodes: DataFrame, sparse: int = 3, recent: int = 15) -> DataFrame:
    """What to know on returning to each project: project, section, place, id, label, type, created_at, updated_at.

    nodes have derived (not null) beside the node columns. Open tasks, decisions and constraints come whole and without a place;
    of what was derived and of the rest the latest few, with their place. A project with fewer than sparse members that are no projects is
    supplemented with the nodes changed most recently anywhere. updated_at is null where it is created_at. Of equal times the
    smaller id comes first.
    """
    columns = ("id", "label", "type", "work_status", "derived", "created_at", "updated_at")
    own = nodes.filter("project_id IS NOT NULL").select(F.col("project_id").alias("project"), *columns)
    projects = nodes.filter("type = 'project'").select(F.col("id").alias("project"))
    full = own.filter("type <> 'project'").groupBy("project").agg(F.count("*").alias("n")).filter(F.col("n") >= sparse).select("project")
    # no more than `recent` rows
    latest = nodes.orderBy(F.desc("updated_at"), "id").limit(recent).select(F.lit(True).alias("lacks"), *columns)
    more = projects.distinct().join(full, "project", "left_anti").withColumn("lacks", F.lit(True)).join(F.broadcast(latest), "lacks").drop("lacks")
    more = more.join(own.select("project", "id"), ["project", "id"], "left_anti")
    known = own.join(projects.distinct(), "project", "left_semi").unionByName(more)
    parts = known.withColumn("section", F.explode(_section())).withColumn("changed", F.nullif("updated_at", "created_at"))
    shown = ("project", "section", "place", "id", "label", "type", "created_at", F.col("changed").alias("updated_at"))
    whole = parts.filter(~F.col("section").isin(*SECTION_LIMITS)).withColumn("place", F.lit(None).cast("bigint")).select(*shown)
    for section, n in SECTION_LIMITS.items():
        whole = whole.unionByName(top_in_group(parts.filter(F.col("section") == section), ["project"], [F.desc("updated_at"), F.col("id")], n).select(*shown))
    return whole


def since(nodes: DataFrame, history: DataFrame, time: Column, looked_at: int = 100, shown: int = 30) -> DataFrame:
    """What changed after a time, in all projects: section (new, updated, changes), place, id, what and at.

    New and updated nodes come whole; of the latest looked_at rows of history (node_id, field, at, seq) those after the time, at most shown.
    """
    made = nodes.filter(F.col("created_at") > time).select(F.lit("new").alias("section"), F.lit(None).cast("bigint").alias("place"), "id", F.col("type").alias("what"), F.col("created_at").alias("at"))
    changed = nodes.filter((F.col("updated_at") > time) & (F.col("created_at") <= time)).select(F.lit("updated").alias("section"), F.lit(None).cast("bigint").alias("place"), "id", F.col("type").alias("what"), F.col("updated_at").alias("at"))
    log = history.orderBy(F.desc("at"), F.desc("seq")).limit(looked_at).filter(F.col("at") > time).withColumn("section", F.lit("changes"))
    # no more than looked_at rows have one window
    log = top_in_group(log, ["section"], [F.desc("at"), F.desc("seq")], shown).select("section", "place", F.col("node_id").alias("id"), F.col("field").alias("what"), "at")
    return made.unionByName(changed).unionByName(log)


def percent(part: Column, of: Column) -> Column:
    """Whole percents, halves up; 0 of nothing."""
    return F.when(of > 0, F.floor(part / of * 100 + 0.5)).otherwise(0).cast("bigint")


def session_report(cycles: DataFrame, writes: DataFrame, recalls: DataFrame, key: str) -> DataFrame:
    """One row a session: what its cycles made, how good and dense that is, lag, cost, limits by pass, and pollution of recalls.

    cycles (key, cycle, billed long, lag_ms long, limited, limit_pass), writes (cycle, type, quality, created), recalls (key, injected, crossed).
    Qualities are rounded into 1 to 6; a node counts as related from 4 on. Costs and percents are rounded with halves up,
    and 0 where nothing was made. Sessions with only recalls or only cycles have a row too; rows without a key have none. types and limits
    are arrays of structs, in order of their name.
    """
    cycles, recalls = (df.filter(F.col(key).isNotNull()) for df in (cycles, recalls))
    made = F.coalesce("created", F.lit(False))
    level = F.least(F.greatest(F.floor(F.col("quality") + 0.5), F.lit(1)), F.lit(6))
    sums = [F.count_if(made).alias("created"), F.count_if(~made).alias("updated"), F.count_if(made & (F.col("quality") >= 4)).alias("related")]
    levels = [f"q{n}" for n in range(1, 7)]
    sums += [F.count_if(made & (level == n)).alias(f"q{n}") for n in range(1, 7)]
    kinds = writes.join(cycles.select("cycle", key), "cycle").groupBy(key, "type").agg(*sums)
    kinds = kinds.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("created", "updated", "related", *levels)), F.array_sort(F.collect_list(F.when(F.col("created") > 0, F.struct("type", F.col("created").alias("n"))))).alias("types"))
    hit = F.coalesce("limited", F.lit(False))
    passes = cycles.groupBy(key, F.when(hit, F.col("limit_pass")).alias("limit_pass")).agg(F.count("*").alias("cycles"), F.count_if(hit).alias("limit_hits"), F.sum("billed").alias("billed"), F.sum("lag_ms").alias("lag"), F.max("lag_ms").alias("max_lag_ms"), F.count("lag_ms").alias("timed"))
    ran = passes.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("cycles", "limit_hits", "billed", "lag", "timed")), F.max("max_lag_ms").alias("max_lag_ms"), F.array_sort(F.collect_list(F.when(F.col("limit_pass").isNotNull(), F.struct("limit_pass", F.col("limit_hits").alias("n"))))).alias("limits"))
    told = recalls.groupBy(key).agg(F.count("*").alias("recalls"), F.sum("injected").alias("injected"), F.sum("crossed").alias("crossed"))
    rows = ran.join(kinds, key, "left").join(told, key, "full_outer")
    rows = rows.fillna(0, ["cycles", "limit_hits", "billed", "lag", "timed", "max_lag_ms", "created", "updated", "related", *levels, "recalls", "injected", "crossed"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) / F.col(b) + 0.5)).otherwise(0).cast("bigint")
    return rows.select(
        key, "cycles", "recalls", "created", "updated", "billed", ratio("billed", "created").alias("cost_per_block"), "limit_hits", "types", *levels,
        percent(F.col("related"), F.col("created")).alias("density_pct"), percent(F.col("updated"), F.col("created") + F.col("updated")).alias("update_pct"),
        ratio("lag", "timed").alias("avg_lag_ms"), "max_lag_ms", "limits", "injected", "crossed", percent(F.col("crossed"), F.col("injected")).alias("pollution_pct"),
    )


def pending_extraction(turns: DataFrame, key: str) -> DataFrame:
    """Turns that are captured and not extracted yet, by key: turns, first, last, topics (the first three names), failed and last_error.

    turns (key, turn, status, name, error). Keys with nothing pending have no row; the last error is that of the latest turn that has one.
    """
    staged = turns.filter("status = 'pass01_done'")
    spans = staged.groupBy(key).agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.max(F.when(F.col("error").isNotNull(), F.struct("turn", "error")))["error"].alias("last_error"))
    names = staged.filter("name <> ''").groupBy(key, "name").agg(F.min("turn").alias("turn"))
    top = top_in_group(names, [key], [F.col("turn"), F.col("name")], 3).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("topics"))
    return spans.join(top, key, "left").select(key, "turns", "first", "last", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), (F.col("errors") > 0).alias("failed"), "last_error")


def recent_extractions(ranges: DataFrame, extracted: DataFrame, nodes: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The latest n ranges of each key by what they gave: topic, span, blocks, chain and time.

    ranges (key, range_id, first, last, at), extracted (range_id, id), nodes (id, label, type, chain_id). The topic is the commonest first segment of the labels,
    of equals the first by name, or the turns if there is none. The chain is the range's own chain node, the first by label, else the one that
    most of its nodes name (of equals the smaller id), if that is a chain.
    """
    latest = top_in_group(ranges, [key], [F.desc("at"), F.desc("range_id")], n)
    rows = latest.select("range_id").join(extracted, "range_id").join(nodes.select("id", "label", "type", "chain_id"), "id")
    segment = F.nullif(scope_segment(F.coalesce("label", F.lit(""))), F.lit(""))
    topics = rows.groupBy("range_id", segment.alias("topic")).agg(F.count("*").alias("c"), F.min(F.when(F.col("type") == "chain", F.col("label"))).alias("own"))
    topics = topics.groupBy("range_id").agg(F.sum("c").alias("blocks"), F.min("own").alias("own"), F.min(F.when(F.col("topic").isNotNull(), F.struct((-F.col("c")).alias("c"), "topic")))["topic"].alias("topic"))
    named = rows.filter("chain_id IS NOT NULL").groupBy("range_id", "chain_id").agg(F.count("*").alias("c"))
    named = named.groupBy("range_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "chain_id"))["chain_id"].alias("chain_id"))
    handles = named.join(nodes.filter("type = 'chain'").select(F.col("id").alias("chain_id"), F.col("label").alias("handle")), "chain_id").select("range_id", "handle")
    shown = latest.join(topics, "range_id", "left").join(handles, "range_id", "left")
    turns = F.concat_ws("-", "first", "last")
    return shown.select(key, "place", "range_id", F.coalesce("topic", F.concat(F.lit("turns "), turns)).alias("topic"), turns.alias("turns"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("own", "handle").alias("chain"), "at")


def overview(nodes: DataFrame, edges: DataFrame, activity: DataFrame, since: Column, newest: int = 5) -> DataFrame:
    """What a session sees first, as rows of section, name, n and at.

    nodes by type with their number, projects, open_tasks, the newest nodes (of equal times the smaller id), active_agents (agents with anything in activity (agent, at)
    since a time, with its number and last time), and unlinked: how many nodes have neither a project nor an edge.
    """
    none = {"name": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint"), "at": F.lit(None).cast("timestamp_ntz")}
    part = lambda df, section, **given: df.select(F.lit(section).alias("section"), *(given.get(c, v).alias(c) for c, v in none.items()))
    named = {"name": F.col("id")}
    kinds = nodes.groupBy("type").agg(F.count("*").alias("c"))
    open_ = nodes.filter((F.col("type") == "task") & (work_status(F.col("work_status"))["status"] != "done"))
    agents = activity.groupBy("agent").agg(F.count("*").alias("c"), F.max("at").alias("last")).filter(F.col("last") >= since)
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    loose = nodes.filter("project_id IS NULL AND type <> 'project'").join(ends, "id", "left_anti").agg(F.count("*").alias("c"))
    rows = part(kinds, "nodes", name=F.col("type"), n=F.col("c"))
    rows = rows.unionByName(part(nodes.filter("type = 'project'"), "projects", **named)).unionByName(part(open_, "open_tasks", **named))
    rows = rows.unionByName(part(nodes.orderBy(F.desc("created_at"), "id").limit(newest), "recent", at=F.col("created_at"), **named))
    return rows.unionByName(part(agents, "active_agents", name=F.col("agent"), n=F.col("c"), at=F.col("last"))).unionByName(part(loose, "unlinked", n=F.col("c")))
