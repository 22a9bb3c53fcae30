"""What a reader is shown of threads: signposts, whole threads, neighbouring threads, bounded chains, trees, chains as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.checkpoints import settled
from .traverse import BRIDGES, CONCLUSIVE, causal_order, chains, components, lookup, walk

#: Node types pinned at their project, before its active tasks and other children.
STANCES = ("constraint", "dead_end", "decision", "blueprint")


def clipped(text: Column, most: int) -> Column:
    """Trimmed text of at most so many characters, with a sign that it was cut; null is empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…"))).otherwise(t)


def grounds(members: DataFrame, grounding: DataFrame) -> DataFrame:
    """members with backed_by, the number of grounding edges at either end of each; they are no steps of the thread."""
    ends = grounding.select(F.col("source_id").alias("id")).unionByName(grounding.select(F.col("target_id").alias("id")))
    return members.join(ends.groupBy("id").agg(F.count("*").alias("backed_by")), "id", "left").withColumn("backed_by", F.coalesce("backed_by", F.lit(0)))


def whole_threads(members: DataFrame, nodes: DataFrame, grounding: DataFrame) -> DataFrame:
    """All members of each thread in order (depth, time, id) with role and backed_by; members are those of traverse.thread.

    Archived members are left out; threads of fewer than two members give no rows.
    """
    known = nodes.filter("status <> 'archived'").select("id", "label", "type", "created_at")
    by = Window.partitionBy("start")
    rows = grounds(members, grounding).join(known, "id").withColumn("__n", F.count("*").over(by)).filter("__n > 1")
    place = F.row_number().over(by.orderBy("depth", "created_at", "id"))
    return rows.select("start", "id", "label", "type", "role", "backed_by", place.cast("bigint").alias("place"))


def signs(members: DataFrame, nodes: DataFrame, grounding: DataFrame, hops: int = 5, lineage: int = 8) -> DataFrame:
    """One signpost a thread: where its focal node came from and where it leads. members: traverse.members.

    lineage: labels, causes first, of the origins, the conclusive nodes at or above the focal one and itself; of more than
    the most, the first and the nearest. leads_to: its direct effects, else the thread's leaves, the most conclusive
    first, then the most read, then by id. Archived nodes are counted in the thread but not shown; a lone node has no sign.
    """
    known = nodes.filter("status <> 'archived'").select("id", "label", "type", "essence", "access_count")
    by = Window.partitionBy("start")
    m = grounds(members, grounding).join(known, "id", "left")
    focal, seen = F.col("id") == F.col("start"), F.col("label").isNotNull()
    facts = m.groupBy("start").agg(F.count("*").alias("size"), F.sum("backed_by").alias("backed_by"), (F.count_if("is_leaf") > 1).alias("forked")).filter("size > 1")

    came = m.filter(seen & (focal | F.col("is_origin") | ((F.col("depth") <= 0) & F.col("type").isin(*CONCLUSIVE))))
    came = came.withColumn("k", F.row_number().over(by.orderBy("depth", "id"))).withColumn("n", F.count("*").over(by))
    came = came.filter((F.col("k") == 1) | (F.col("k") > F.col("n") - (lineage - 1)))
    came = came.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "label", "essence"))).alias("c"))

    hop = (F.col("depth") == 1) & ~focal
    next_ = m.filter(seen & ~focal & (hop | F.col("is_leaf"))).withColumn("hops", F.count_if(hop).over(by)).filter(hop | (F.col("hops") == 0))
    weight = F.coalesce(lookup(CONCLUSIVE)[F.col("type")], F.lit(1))
    next_ = next_.withColumn("k", F.row_number().over(by.orderBy(weight.desc(), F.desc("access_count"), "id"))).withColumn("n", F.count("*").over(by)).filter(F.col("k") <= hops)
    next_ = next_.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "label", "essence"))).alias("l"), F.max("n").alias("n"))

    one = facts.join(came, "start").join(next_, "start", "left")
    return one.select(
        "start",
        F.array_join("c.label", " > ").alias("lineage"),
        F.array_join("l.label", " > ").alias("leads_to"),
        F.greatest(F.coalesce("n", F.lit(0)) - hops, F.lit(0)).cast("bigint").alias("more_leaves"),
        "backed_by",
        "forked",
        F.col("n").isNull().alias("terminal"),
        F.when(F.size("c") > 1, F.array_join(F.transform("c", lambda x: clipped(x["essence"], 60)), "  →  ")).alias("arc"),
        F.nullif(F.coalesce(F.get("l.essence", F.lit(0)), F.element_at("c.essence", -1)), F.lit("")).alias("conclusion"),
    )


def bounded_chain(edges: DataFrame, starts: DataFrame, nodes: DataFrame, up: int = 7, down: int = 5) -> DataFrame:
    """Causes and effects of each start within so many steps: start, id, depth, via, gist and whether it is the start.

    What both directions reach is a cause. via is the type of the edge by which a node was reached, the first by name.
    """
    causes = walk(edges, starts, True, up).select("start", "id", (-F.col("depth")).alias("depth"))
    effects = walk(edges, starts, False, down).join(causes.select("start", "id"), ["start", "id"], "left_anti")
    rows = causes.unionByName(effects)
    above = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("id"), "type", F.lit(1).alias("step"))
    below = edges.select(F.col("target_id").alias("from"), F.col("source_id").alias("id"), "type", F.lit(-1).alias("step"))
    before = rows.select("start", F.col("id").alias("from"), F.col("depth").alias("from_depth"))
    reached = rows.filter("depth <> 0").join(above.unionByName(below), "id").filter("signum(depth) = -step").join(before, ["start", "from"]).filter("from_depth = depth + step")
    via = reached.groupBy("start", "id").agg(F.min("type").alias("via"))
    known = nodes.select("id", F.when(F.length("essence") > 120, F.concat(F.substring("essence", 1, 120), F.lit("…"))).otherwise(F.coalesce("essence", F.lit(""))).alias("gist"))
    return rows.join(known, "id").join(via, ["start", "id"], "left").select("start", "id", "depth", "via", "gist", (F.col("depth") == 0).alias("is_focal"))


def linked_threads(members: DataFrame, spine: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 12, comps: DataFrame | None = None) -> DataFrame:
    """Other threads that bridging edges tie each thread to, strongest first: start, thread, via, handle and place.

    A thread is a component of the spine, or a node off it, and is named by its smallest id. Each comes once, by its strongest
    bridge (then the smallest id met). The handle is the thread's most conclusive end that is not archived, then the most
    read, else the node met. comps are the components of the spine, where they are known already.
    """
    e = edges.filter(F.col("type").isin(*BRIDGES)).select("source_id", "target_id", "type")
    ways = e.unionByName(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type"))
    held = members.select("start", F.col("id").alias("target_id"))
    met = members.select("start", F.col("id").alias("source_id")).join(ways, "source_id").join(held, ["start", "target_id"], "left_anti")
    of = (components(spine) if comps is None else comps).withColumnRenamed("id", "target_id")
    met = met.join(of, "target_id", "left").withColumn("thread", F.coalesce("component", "target_id")).withColumn("strength", lookup(BRIDGES)[F.col("type")])
    best = met.groupBy("start", "thread").agg(F.min(F.struct((-F.col("strength")).alias("w"), "target_id", "type")).alias("b"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("b.w", "thread"))
    best = best.withColumn("place", place.cast("bigint")).filter(F.col("place") <= most)
    ends = of.select(F.col("target_id").alias("id"), F.col("component").alias("thread")).join(best.select("thread").distinct(), "thread", "left_semi")
    ends = ends.join(spine.select(F.col("target_id").alias("id")), "id", "left_anti").join(nodes.filter("status <> 'archived'").select("id", "type", "access_count"), "id")
    weight = F.coalesce(lookup(CONCLUSIVE)[F.col("type")], F.lit(1))
    ends = ends.groupBy("thread").agg(F.min(F.struct((-weight).alias("w"), (-F.col("access_count")).alias("a"), "id"))["id"].alias("end"))
    return best.join(ends, "thread", "left").select("start", "thread", F.col("b.type").alias("via"), F.coalesce("end", "b.target_id").alias("handle"), "place")


def tree(nodes: DataFrame, levels: int = 4) -> DataFrame:
    """Each live project with what is below it, as rows: root, id, parent, depth, role and number of children.

    Stances and active tasks of a project are pinned under it and not opened; all else is a child and is opened down to
    the levels given. Projects are no one's children here but count as such; archived nodes count but are not shown.
    """
    size = nodes.filter("project_id IS NOT NULL").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("children"))
    shown = nodes.filter("status <> 'archived' AND type <> 'project'").select("id", F.col("project_id").alias("parent"), "type", "work_status")
    level = nodes.filter("status <> 'archived' AND type = 'project'").select(F.col("id").alias("root"), "id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("depth"), F.lit("project").alias("role"))
    rows = level
    for depth in range(1, levels + 1):
        open_ = level.filter("role IN ('project', 'child')").select("root", F.col("id").alias("parent"), (F.col("role") == "project").alias("pins"))
        role = F.when(F.col("pins") & F.col("type").isin(*STANCES), F.col("type")).when(F.col("pins") & (F.col("type") == "task") & (F.col("work_status") == "in_progress"), "active_task").otherwise("child")
        level = shown.join(open_, "parent").select("root", "id", "parent", F.lit(depth).cast("bigint").alias("depth"), role.alias("role"))
        rows = rows.unionByName(level)
    return rows.join(size, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def chain_texts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mechanical chains (traverse.chains) with label, essence and conclusion; and their members, causes first, with types."""
    comps = components(edges)
    found = settled(chains(nodes, edges, comps=comps))
    part = comps.withColumnRenamed("component", "chain").join(found.select("chain"), "chain", "left_semi")
    rows = part.join(nodes.select("id", "label", "type", "essence", "created_at"), "id")
    ordered = causal_order(rows, edges).join(rows.select("id", "label", "type", "essence"), "id")
    first = ordered.filter("place = 1").select("chain", F.col("essence").alias("first"))
    last = nodes.select(F.col("id").alias("terminal"), F.col("label").alias("l"), F.col("essence").alias("last"))
    words = F.split("l", "_")
    concept = F.coalesce(F.nullif(F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(1))), "-"), F.lit("")), F.lit("arc"))
    whole = found.join(first, "chain").join(last, "terminal")
    whole = whole.select(
        "chain", "members", "terminal", "terminal_type",
        F.substring(F.concat(words[0], F.lit("_chain_"), concept), 1, 120).alias("label"),
        clipped(F.concat(clipped(F.col("first"), 60), F.lit(" → "), clipped(F.col("last"), 70)), 140).alias("essence"),
        clipped(F.col("last"), 80).alias("conclusion"),
    )
    return whole, ordered.select("chain", "place", "id", "label", "type")


def members_in_order(nodes: DataFrame, member_of: DataFrame, spine: DataFrame) -> DataFrame:
    """Live members of each chain, causes first. nodes carry chain_id; member_of edges (member to chain) go before it.

    A chain that has a live member by an edge has only those; another has the nodes whose chain_id names it.
    """
    seen = nodes.filter("status <> 'archived'")
    linked = member_of.select(F.col("source_id").alias("id"), F.col("target_id").alias("chain")).distinct().join(seen.select("id", "created_at"), "id")
    named = seen.filter("chain_id IS NOT NULL").select("id", F.col("chain_id").alias("chain"), "created_at").join(linked.select("chain").distinct(), "chain", "left_anti")
    return causal_order(linked.unionByName(named), spine)
