"""Lifecycle rules and audits: retention, gaps, duplicates, conflicts, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms
from ..sources.checkpoints import settled
from ..sources.graph import current, live, normal_text
from .grams import contained

#: Node types that are never archived, and the hours after which a time to live ends.
PROTECTED = ("decision", "constraint", "project")
LIFETIME_HOURS = {"1hr": 1, "24hr": 24, "1week": 168, "session": 24}
#: Words for a finished and a begun piece of work; others are open.
DONE = ("done", "complete", "completed", "finished", "shipped", "fixed", "resolved", "closed", "merged", "deployed", "landed", "implemented")
BEGUN = ("in_progress", "in-progress", "in progress", "wip", "started", "ongoing", "underway", "building", "active")
OPEN = ("open", "todo", "to-do", "pending", "proposed", "planned", "required", "needed", "owed", "blocked", "not started", "unstarted", "")
#: Bits of what edges say of a node: has one, comes from a cause, contradicts something.
LINKED, CAUSED, AGAINST = 1, 2, 4
RANKS = {"open": 0, "in_progress": 1, "done": 2}


def promoted(nodes: DataFrame) -> DataFrame:
    """Short-lived nodes read three times or more become permanent."""
    hot = F.col("ttl").isin("session", "1hr") & (F.col("access_count") >= 3)
    return nodes.withColumn("promoted", hot).withColumn("ttl", F.when(hot, "permanent").otherwise(F.col("ttl")))


def collected(nodes: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """What retention does with each live node: promote first, then protect, archive or keep."""
    ends = current(edges).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("held", F.lit(True))
    limits = F.create_map(*(F.lit(x) for p in LIFETIME_HOURS.items() for x in p))
    age = F.timestamp_diff("SECOND", F.col("updated_at"), now)
    rows = promoted(live(nodes)).join(ends, "id", "left")
    action = F.when(F.col("type").isin(*PROTECTED) | (F.col("ttl") == "permanent") | F.col("held"), "protect").when(age > limits[F.col("ttl")] * 3600, "archive").otherwise("keep")
    return rows.select("id", "type", "promoted", action.alias("action"))


def work_status(raw: Column) -> Column:
    """Struct of status (open, in_progress, done) and the note that keeps words of no known meaning."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    status = F.when(t.isin(*DONE), "done").when(t.isin(*BEGUN), "in_progress").otherwise("open")
    return F.struct(status.alias("status"), F.when(~t.isin(*DONE, *BEGUN, *OPEN), F.trim(raw)).alias("note"))


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Open ends by kind: orphan nodes, tasks without a cause, dead ends that contradict nothing."""
    held = current(edges)
    # nodes and ends of edges are put together in one grouping by id, with counts and bits only: no rows are sorted or joined
    known = live(nodes)
    one = lambda test: F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("int")
    none = F.lit(0).cast("int")
    met = known.select("id", one(F.lit(True)).alias("n"), one(F.col("type") == "task").alias("tasks"), one(F.col("type") == "dead_end").alias("dead_ends"), none.alias("bits"))
    bits = F.lit(LINKED) + F.when(F.col("type").isin("prompted_by", "based_on"), CAUSED).when(F.col("type") == "contradicts", AGAINST).otherwise(0)
    end = lambda id_, bits: F.struct(F.col(id_).alias("id"), none.alias("n"), none.alias("tasks"), none.alias("dead_ends"), bits.cast("int").alias("bits"))
    links = held.select(F.inline(F.array(end("source_id", bits), end("target_id", F.lit(LINKED))))).filter("id IS NOT NULL")
    seen = met.unionByName(links).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "tasks", "dead_ends")), F.bit_or("bits").alias("bits")).filter("n > 0")
    open_ = lambda gap, n, bit: F.struct(F.lit(gap).alias("gap"), F.when(F.col("bits").bitwiseAND(bit) == 0, F.col(n)).otherwise(0).cast("int").alias("n"))
    gap = F.array(open_("orphan", "n", LINKED), open_("task_without_cause", "tasks", CAUSED), open_("dead_end_without_conflict", "dead_ends", AGAINST))
    # an id that several nodes have is told as often
    return seen.select("id", F.inline(gap)).filter("n > 0").select("gap", "id", F.explode(F.array_repeat(F.lit(True), F.col("n"))).alias("__again")).drop("__again")


def gap_report(nodes: DataFrame, edges: DataFrame, conflicts: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """All open ends of live nodes by kind: gap, id and detail.

    orphan: no edge, projects and agents' sessions apart. task: not done, with the kinds it isn't tied to (decision,
    constraint). open_question: tied to no fact, decision or answer. open_conflict: conflicts (id, detail). dead_end: no
    contradicts edge at either end. stale_draft: seven days old and not promoted. next_question: questions (id, detail).
    """
    known = live(nodes).select("id", "label", "type", "work_status", "created_at")
    held = current(edges).select("source_id", "target_id", "type")
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    links = held.select("type", F.inline(ends))
    tied = links.select("id").distinct()
    status = F.lower(F.coalesce("work_status", F.lit("")))
    asked = known.filter((F.col("type") == "question") | ((F.col("type") == "task") & ~status.isin("done", "completed", "archived"))).select("id", "type")
    # a hub's many edges become one row of three flags before the kinds are put together
    seen = links.select("id", "other").join(asked.select("id"), "id", "left_semi").join(known.select(F.col("id").alias("other"), F.col("type").alias("kind")), "other")
    flags = seen.groupBy("id").agg(*(F.bool_or(F.col("kind").isin(*kinds)).alias(name) for name, kinds in (("decision", ("decision",)), ("constraint", ("constraint",)), ("answer", ("fact", "decision", "answer")))))
    state = asked.join(flags, "id", "left").na.fill(False, ["decision", "constraint", "answer"])
    missing = F.concat_ws(",", F.when(~F.col("decision"), "decision"), F.when(~F.col("constraint"), "constraint"))
    none = F.lit(None).cast("string").alias("detail")
    against = links.filter("type = 'contradicts'").select("id").distinct()
    old = (F.col("type") == "draft") & (status != "promoted") & (F.col("created_at") < now - F.make_dt_interval(days=F.lit(7)))
    parts = [
        known.filter((F.col("type") != "project") & ~F.startswith("label", F.lit("agent_session_"))).join(tied, "id", "left_anti").select(F.lit("orphan").alias("gap"), "id", none),
        state.filter("type = 'task'").select(F.lit("task").alias("gap"), "id", missing.alias("detail")).filter("detail <> ''"),
        state.filter("type = 'question' AND NOT answer").select(F.lit("open_question").alias("gap"), "id", none),
        conflicts.select(F.lit("open_conflict").alias("gap"), "id", "detail"),
        known.filter("type = 'dead_end'").join(against, "id", "left_anti").select(F.lit("dead_end").alias("gap"), "id", none),
        known.filter(old).select(F.lit("stale_draft").alias("gap"), "id", none),
        questions.select(F.lit("next_question").alias("gap"), "id", "detail"),
    ]
    return reduce(DataFrame.unionByName, parts)


def shared_tokens(items: DataFrame, least: int, scope: str = "scope", text: str = "value") -> DataFrame:
    """Pairs of items of one scope (id, scope, value) that share least distinct words of four characters or more.

    Candidates meet on a word, never all with all; equal texts are one item first, so groups of copies give no pairs here.
    """
    words = items.select("id", scope, F.explode(terms(F.col(text), 4)).alias("word"))
    a, b = words.alias("a"), words.alias("b")
    met = a.join(b, F.expr(f"a.word = b.word AND a.{scope} = b.{scope} AND a.id < b.id"))
    return met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def equal_values(items: DataFrame, value: Column) -> DataFrame:
    """Groups of items with the same value: the first id, how many and in how many scopes; null values are no value."""
    return items.withColumn("v", value).filter("v IS NOT NULL AND v <> ''").groupBy(F.md5("v").alias("digest")).agg(F.min("id").alias("first"), F.count("*").alias("n"), F.countDistinct("scope").alias("scopes")).filter("n > 1")


def islands(concepts: DataFrame, least: int, edges: DataFrame) -> DataFrame:
    """Pairs of nodes (id, concepts) that share least concepts and have no edge; nodes with equal concepts stand as one.

    A pair's concepts are compared through their kinds: a kind is a set of concepts, and kinds are few, so the pairs are
    those of kinds with the number of nodes on either side.
    """
    kinds = concepts.withColumn("kind", F.array_join(F.array_sort(F.array_distinct("concepts")), "\x01")).filter("kind <> ''")
    sizes = kinds.groupBy("kind").agg(F.count("*").alias("nodes"), F.min("id").alias("first"))
    parts = sizes.withColumn("c", F.explode(F.split("kind", "\x01")))
    met = parts.alias("a").join(parts.alias("b"), F.expr("a.c = b.c AND a.first < b.first")).groupBy(F.col("a.first").alias("a"), F.col("b.first").alias("b"), F.col("a.nodes").alias("a_nodes"), F.col("b.nodes").alias("b_nodes")).agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    tied = current(edges).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    return met.join(tied, ["a", "b"], "left_anti")


def merged(edges: DataFrame, winners: DataFrame) -> DataFrame:
    """Edges after losers (loser, winner) gave theirs to the winners: no loops, each edge once, plus supersedes edges.

    part_of and supersedes edges of losers are not carried over.
    """
    a = winners.select(F.col("loser").alias("source_id"), F.col("winner").alias("new_source"))
    b = winners.select(F.col("loser").alias("target_id"), F.col("winner").alias("new_target"))
    moved = edges.select("source_id", "target_id", "type").join(a, "source_id", "left").join(b, "target_id", "left")
    moved = moved.filter(~F.col("type").isin("part_of", "supersedes") | (F.col("new_source").isNull() & F.col("new_target").isNull()))
    ends = moved.select(F.coalesce("new_source", "source_id").alias("source_id"), F.coalesce("new_target", "target_id").alias("target_id"), "type").filter("source_id <> target_id").distinct()
    return ends.unionByName(winners.select(F.col("winner").alias("source_id"), F.col("loser").alias("target_id"), F.lit("supersedes").alias("type")))


def provenance(claims: DataFrame, texts: DataFrame, fuzzy: float = 0.85) -> DataFrame:
    """Whether each claim (id, excerpt) lies in each linked text (id, text): exact, fuzzy or missing.

    exact: the normalised excerpt is in the normalised text; fuzzy: the text has that share of the excerpt's distinct words.
    """
    e, t = normal_text(F.col("excerpt")), normal_text(F.col("text"))
    state = held_state(e, t, terms(F.col("excerpt"), 1), terms(F.col("text"), 1), fuzzy)
    return claims.join(texts, "id", "left").withColumn("state", F.when(F.col("text").isNull(), "no_link").otherwise(state))


def held_state(excerpt: Column, text: Column, words: Column, text_words: Column, fuzzy: float) -> Column:
    share = F.size(F.array_intersect(words, text_words)) / F.greatest(F.size(words), F.lit(1))
    return F.when(F.contains(text, excerpt), "exact").when(share >= fuzzy, "fuzzy").otherwise("missing")


def held_passages(passages: DataFrame, texts: DataFrame, fuzzy: float = 0.85) -> DataFrame:
    """Every passage (item_id, text) that each text (doc_id, text) holds: doc_id, item_id, exact or fuzzy.

    Texts that hold none give one row, missing, without an item_id; blank passages are none. Nothing is passed over: a text
    that holds a passage of n words lacks at most n - fuzzy * n of them, or its first and last, which may be parts of words,
    so it has one of any k = max(n - floor(fuzzy * n) + 1, 3). Passages are met on their k rarest words, then checked
    in full. Which words are rare is taken from a sixteenth of the texts; that changes the pairs met, never the result.
    Passages of under three words need all of these, or lie within one or two pieces of a text between spaces: they are met on
    one word, and on the pieces that contain their longest piece.
    """
    asked = settled(passages.filter(normal_text(F.col("text")) != "").select("item_id", F.col("text").alias("excerpt"), terms(F.col("text"), 1).alias("words")))
    n = F.size("words")
    enough = F.when(n >= 3, F.greatest(n - F.floor(n * F.lit(fuzzy)) + 1, F.lit(3))).otherwise(n - F.ceil(n * F.lit(fuzzy)) + 1)
    words = asked.select("item_id", enough.alias("k"), F.explode("words").alias("word"))
    spread = texts.select("doc_id", F.explode(terms(F.col("text"), 1)).alias("word"))
    seen = spread.filter(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), F.desc(F.length("word")), "word"))
    index = settled(words.join(seen, "word", "left").withColumn("place", rarest).filter("place <= k").select("word", "item_id"))
    pairs = spread.join(index, "word").select("doc_id", "item_id")
    pieces = lambda text: F.split(normal_text(text), " ")
    longest = F.array_max(F.transform(pieces(F.col("excerpt")), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    short = asked.filter(n < 3).select("item_id", longest.alias("needle"))
    if not short.isEmpty():
        there = texts.select("doc_id", F.explode(F.array_distinct(pieces(F.col("text")))).alias("string"))
        pairs = pairs.unionByName(contained(short, there).join(short, "needle").join(there, "string").select("doc_id", "item_id"))
    met = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    rows = texts.join(met, "doc_id")
    read = rows.select("doc_id", "items", normal_text(F.col("text")).alias("t"), terms(F.col("text"), 1).alias("text_words"))
    pairs = read.select("doc_id", F.explode("items").alias("item_id"), "t", "text_words").join(asked.select("item_id", normal_text(F.col("excerpt")).alias("e"), "words"), "item_id")
    found = settled(pairs.select("doc_id", "item_id", held_state(F.col("e"), F.col("t"), F.col("words"), F.col("text_words"), fuzzy).alias("state")).filter("state <> 'missing'"))
    none = texts.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(none.select("doc_id", F.lit(None).cast(found.schema["item_id"].dataType).alias("item_id"), F.lit("missing").alias("state")))


def next_tasks(tasks: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """Open tasks (id, priority, created_at) all of whose needs (id, needed) are done, in order of work."""
    missing = needs.join(done.select(F.col("id").alias("needed")), "needed", "left_anti").select("id").distinct()
    level = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return tasks.join(missing, "id", "left_anti").withColumn("level", level.cast("bigint"))
