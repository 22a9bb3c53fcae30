"""Flags on one or two nodes, from writing to verdict. A batch is one pass: every flag is decided at most once.

Flags: flag_id, flag_type, block_a, block_b (null: none), scope_check, origin_writer, reviewed_at, verdict, action, winner.
A flag with the verdict pending_clarification and no reviewed_at waits for the agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Types left for later review, verdicts that may be applied, what a merge is called.
DEFERRED = ("island_candidate", "entity_unresolved")
VERDICTS = ("merge", "leave", "split")
ASKED = "pending_clarification"
MERGED = "archived_loser_and_wired_superseded_by"


def is_open() -> Column:
    return F.col("reviewed_at").isNull() & ~F.coalesce(F.col("verdict") == ASKED, F.lit(False))


def pending(flags: DataFrame) -> DataFrame:
    """Flags that no one has decided and that were not handed to the agent."""
    return flags.filter(is_open())


def asked(flags: DataFrame) -> DataFrame:
    """Flags handed to the agent and still open."""
    return flags.filter(F.col("reviewed_at").isNull() & (F.col("verdict") == ASKED))


def by_block(flags: DataFrame, reviewed: bool | None = None) -> DataFrame:
    """Flags by each node they name, on either side once; all, or only those reviewed or not."""
    if reviewed is not None:
        flags = flags.filter(F.col("reviewed_at").isNotNull() == reviewed)
    return flags.withColumn("block", F.explode(F.array_compact(F.array_distinct(F.array("block_a", "block_b")))))


def _is_side(winner: Column) -> Column:
    return F.coalesce((winner == F.col("block_a")) | (winner == F.col("block_b")), F.lit(False))


def routed(flags: DataFrame, nodes: DataFrame, judged: DataFrame, now: Column, auto_merge: bool = True) -> DataFrame:
    """Flags after a reviewer's pass, with the step taken: ask, defer, stale, merge, record, wait or none (not open before).

    judged (flag_id, said, confidence, winner; one row a flag) is what a reviewer said; a flag it does not have waits. Whether
    later work settled an item, and whose a node of unknown owner is, is asked, never judged. A merge is done only if it is
    sure and names one of the two; other merges are asked. Without auto_merge a merge is recorded and not done.
    """
    alive = nodes.filter("status <> 'archived'").select(F.col("id").alias("block_a"), F.lit(True).alias("__alive"))
    said = judged.select("flag_id", F.when(F.col("said").isin("merge", "split"), F.col("said")).otherwise("leave").alias("__said"), F.col("confidence").alias("__sure"), F.col("winner").alias("__winner"))
    f = flags.join(alive, "block_a", "left").join(said, "flag_id", "left")
    sure = F.coalesce(F.col("__sure") == "high", F.lit(False)) & _is_side(F.col("__winner"))
    merge = (F.col("__said") == "merge") & F.lit(auto_merge)
    step = (
        F.when(~is_open(), "none")
        .when(F.col("flag_type") == "resolution_pending", "ask")
        .when(F.col("flag_type").isin(*DEFERRED), "defer")
        .when((F.col("origin_writer") == "stage_d_resolve") & (F.col("scope_check") == "unknown"), "ask")
        .when(F.col("__alive").isNull(), "stale")
        .when(F.col("__said").isNull(), "wait")
        .when(merge & sure & F.col("block_b").isNotNull(), "merge")
        .when(merge & ~sure, "ask")
        .otherwise("record")
    )
    f = f.withColumn("step", step)
    decided = F.col("step").isin("defer", "stale", "merge", "record")
    verdict = F.when(F.col("step") == "ask", ASKED).when(F.col("step").isin("defer", "stale"), "leave").when(decided, F.col("__said")).otherwise(F.col("verdict"))
    winner = F.when((F.col("step") == "merge") | ((F.col("step") == "record") & (F.col("__said") == "merge") & F.lit(not auto_merge)), F.col("__winner")).otherwise(F.col("winner"))
    after = {
        "verdict": verdict,
        "reviewed_at": F.when(decided, now).otherwise(F.col("reviewed_at")),
        "action": F.when(F.col("step") == "merge", MERGED).when(decided, "none").otherwise(F.col("action")),
        "winner": winner,
    }
    return f.withColumns(after).select(*flags.columns, "step")


def applied(flags: DataFrame, verdicts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Flags after verdicts (flag_id, seq, said, reason, winner, execute), and the outcome of each: ok or why not.

    Of several right verdicts for a flag the first by seq counts; the others, and those for reviewed flags, come too late.
    A flag that waits for the agent takes a verdict like any open one.
    """
    v = verdicts.select("flag_id", "seq", "said", "reason", F.col("winner").alias("said_winner"), F.coalesce("execute", F.lit(False)).alias("execute"))
    j = v.join(flags.select("flag_id", "block_a", "block_b", "reviewed_at"), "flag_id")
    merges = F.col("execute") & (F.col("said") == "merge")
    wrong = (
        F.when(~F.coalesce(F.col("said").isin(*VERDICTS), F.lit(False)), "BAD_VERDICT")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "REASON_REQUIRED")
        .when(merges & F.col("said_winner").isNull(), "WINNER_REQUIRED")
        .when(merges & ~_is_side(F.col("said_winner")), "BAD_WINNER")
        .when(merges & F.col("block_b").isNull(), "NO_LOSER")
        .when(F.col("reviewed_at").isNotNull(), "ALREADY_REVIEWED")
    )
    j = j.withColumn("wrong", wrong)
    place = F.row_number().over(Window.partitionBy("flag_id", F.col("wrong").isNull()).orderBy("seq"))
    j = j.withColumn("outcome", F.coalesce("wrong", F.when(place > 1, "ALREADY_REVIEWED"), F.lit("ok")))
    ok = j.filter("outcome = 'ok'").select("flag_id", "said", "said_winner", F.when(merges, MERGED).otherwise("none").alias("did"))
    f = flags.join(ok, "flag_id", "left")
    here = F.col("said").isNotNull()
    after = f.withColumns({
        "verdict": F.when(here, F.col("said")).otherwise(F.col("verdict")),
        "winner": F.when(here, F.col("said_winner")).otherwise(F.col("winner")),
        "action": F.when(here, F.col("did")).otherwise(F.col("action")),
        "reviewed_at": F.when(here, now).otherwise(F.col("reviewed_at")),
    })
    return after.select(*flags.columns), j.select("flag_id", "seq", "outcome")
