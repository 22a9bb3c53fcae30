"""Sessions, rolling sums, cooldowns and usage roll-ups over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.checkpoints import settled
from .intervals import in_intervals, micros


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours") -> DataFrame:
    """Events of a key closer than gap are one session: key, start, end (of the last event), events and value."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    found = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended"), F.round(F.sum("value"), 4).alias("value"))
    return found.select(key, "started", "ended", "events", "value")


def rolling(events: DataFrame, key: str, seconds: int, value: str = "value", ts: str = "ts") -> Column:
    """Sum of value over the seconds up to each event of the key."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return F.sum(value).over(w)


#: Gaps that a bucket of a key's events spans.
BUCKET_GAPS = 16


def next_rows(rows: DataFrame, asks: DataFrame, key: str, width: int) -> DataFrame:
    """n and next: for each of asks (n, key, at) the n of the first of rows (n, key, t, order) of its key at or after its time, if any.

    Times are in microseconds. A key is cut into buckets of time of a width. Within a bucket one sorted stream finds the next row;
    where there is none, the next bucket that has rows begins with it. So a key of many rows is the work of many tasks.
    """
    events = rows.select(key, F.col("t").alias("at"), "order", F.col("n").alias("event"), F.lit(None).cast("bigint").alias("asks"))
    # asked before the events of the same time
    asked = asks.select(key, "at", F.lit(None).cast(rows.schema["order"].dataType).alias("order"), F.lit(None).cast("bigint").alias("event"), F.col("n").alias("asks"))
    both = events.unionByName(asked).withColumn("bucket", F.floor(F.col("at") / width))
    # read backwards, since a frame that begins at the row and ends with the group is read anew for every row
    ahead = Window.partitionBy(key, "bucket").orderBy(F.desc("at"), F.desc(F.col("asks").isNull()), F.desc("order")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("next", F.last("event", ignorenulls=True).over(ahead)).filter("asks IS NOT NULL").select(key, "bucket", F.col("asks").alias("n"), "next")
    begins = events.withColumn("bucket", F.floor(F.col("at") / width)).groupBy(key, "bucket").agg(F.min_by("event", F.struct("at", "order")).alias("begin"))
    every = found.select(key, "bucket").distinct().join(begins, [key, "bucket"], "full_outer")
    later = Window.partitionBy(key).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("begin", F.last("begin", ignorenulls=True).over(later))
    return found.join(every, [key, "bucket"]).select("n", F.coalesce("next", "begin").alias("next")).filter("next IS NOT NULL")


def successors(rows: DataFrame, key: str, seconds: int) -> DataFrame:
    """n and next of rows (n, key, t in microseconds, order): the first row of the key at or after t and the seconds, if any."""
    gap = seconds * 1_000_000
    return next_rows(rows, rows.select("n", key, (F.col("t") + gap).alias("at")), key, BUCKET_GAPS * gap)


def followed(rows: DataFrame, jump: DataFrame, key: str) -> DataFrame:
    """n of each key's first row, and of all that is reached from it by jump (n, next).

    Pointers are followed twice as far each round, so rounds grow with the logarithm of the longest path; every round is a stored table.
    """
    jump = settled(jump)
    marks = settled(rows.groupBy(key).agg(F.min_by("n", F.struct("t", "order")).alias("n")).select("n"))
    while True:
        more = settled(marks.join(jump, "n").select(F.col("next").alias("n")))
        if more.isEmpty():
            return marks
        marks = settled(marks.unionByName(more))
        jump = settled(jump.join(jump.select(F.col("n").alias("next"), F.col("next").alias("far")), "next").select("n", F.col("far").alias("next")))


def cooled(events: DataFrame, key: str, order: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Events that fire: the first of a key, and each that comes seconds or more after the last that fired.

    Each event points at the one that would fire next, and the pointers are followed from a key's first event. Rows without a key or a
    time never fire; seconds are 1 or more.
    """
    rows = settled(events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, order, ts).withColumn("n", F.monotonically_increasing_id()))
    timed = rows.select("n", key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("order"))
    return rows.join(followed(timed, successors(timed, key, seconds), key), "n", "left_semi").drop("n")


def claims(attempts: DataFrame, releases: DataFrame, seconds: int) -> DataFrame:
    """Attempts to claim a block (block, agent, at, seq), with claimed, claimed_by and expires_at: one holder a block at a time.

    A claim ends when its time is over, or when its agent releases the block (block, agent, at) after it was made. An attempt holds the block
    if nothing does, its own agent's claim included; at the time of expiry itself the claim still stands, at that of a release it does not. Of attempts of one time the
    smaller seq comes first. Others name the holder. Each attempt points at the first that its claim would leave free, so no block is
    one task's work. Attempts without a block, agent or time are left out; seq is a number and no two attempts share one.
    """
    whole = lambda df: df.filter("block IS NOT NULL AND agent IS NOT NULL AND at IS NOT NULL").withColumn("t", micros(F.col("at")))
    ttl = seconds * 1_000_000
    tries = settled(whole(attempts).select("block", "agent", "at", "t", F.col("seq").alias("order"), F.monotonically_increasing_id().alias("n")).withColumn("pair", F.struct("block", "agent")))
    freed = settled(whole(releases).select(F.struct("block", "agent").alias("pair"), "t", F.lit(0).alias("order"), F.monotonically_increasing_id().alias("n")))
    let_go = next_rows(freed, tries.select("n", "pair", (F.col("t") + 1).alias("at")), "pair", BUCKET_GAPS * ttl)
    let_go = let_go.join(freed.select(F.col("n").alias("next"), F.col("t").alias("freed")), "next").select("n", "freed")
    held = settled(tries.join(let_go, "n", "left").withColumn("ends", F.least(F.col("t") + ttl + 1, "freed")).drop("pair", "freed"))
    jump = next_rows(held, held.select("n", "block", F.col("ends").alias("at")), "block", BUCKET_GAPS * ttl)
    won = settled(held.join(followed(held, jump, "block"), "n", "left_semi"))
    lost = held.join(won.select("n"), "n", "left_anti").select("block", "agent", "at", F.col("t").alias("tried"), F.col("order").alias("seq"))
    spans = won.select("block", F.col("agent").alias("claimed_by"), F.col("t").alias("low"), (F.col("ends") - 1).alias("high"))
    lost = in_intervals(lost, spans, "block", "tried").select("block", "agent", "at", "seq", F.lit(False).alias("claimed"), "claimed_by", F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    got = won.select("block", "agent", "at", F.col("order").alias("seq"), F.lit(True).alias("claimed"), F.col("agent").alias("claimed_by"), (F.col("at") + F.make_dt_interval(secs=F.lit(seconds))).cast("timestamp_ntz").alias("expires_at"))
    return got.unionByName(lost)


def reminders(edits: DataFrame, reads: DataFrame, stale: int, grace: int) -> DataFrame:
    """Edits (id, client, file, at) with remind and why: never read, stale, no_file, grace, new_file or seen.

    The last read (client, at) at or before an edit decides: more than stale seconds ago reminds, less than grace seconds ago does not. Else the
    first edit of a file since that read reminds, of equal times the smaller id; edits that were stale or in grace don't count as a touch. Edits
    without a client or time are left out; ids are unique. The last read is found in buckets of time, so no client is one task's work.
    """
    known = settled(edits.filter("client IS NOT NULL AND at IS NOT NULL").select("id", "client", "file", "at").withColumns({"t": micros(F.col("at")), "n": F.monotonically_increasing_id()}))
    # the last at or before is the next when time runs backwards; reads of one time are one
    seen = settled(reads.filter("client IS NOT NULL AND at IS NOT NULL").select("client", micros(F.col("at")).alias("read")).distinct().withColumn("n", F.monotonically_increasing_id()))
    back = next_rows(seen.select("n", "client", (-F.col("read")).alias("t"), F.lit(0).alias("order")), known.select("n", "client", (-F.col("t")).alias("at")), "client", BUCKET_GAPS * stale * 1_000_000)
    last = back.join(seen.select(F.col("n").alias("next"), "read"), "next").select("n", "read")
    rows = known.join(last, "n", "left").withColumn("ago", F.col("t") - F.col("read"))
    why = F.when(F.col("read").isNull(), "never").when(F.col("ago") > stale * 1_000_000, "stale").when(F.coalesce("file", F.lit("")) == "", "no_file").when(F.col("ago") < grace * 1_000_000, "grace")
    rows = settled(rows.withColumn("why", why))
    first = rows.filter("why IS NULL").groupBy("client", "file", "read").agg(F.min_by("n", F.struct("t", "id")).alias("n")).select("n", F.lit(True).alias("first"))
    rows = rows.join(first, "n", "left").withColumn("why", F.coalesce("why", F.when(F.col("first"), "new_file"), F.lit("seen")))
    return rows.select("id", "client", "file", "at", "why", F.col("why").isin("never", "stale", "new_file").alias("remind"))


def triggers(events: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The rows at which a key has n more than at the trigger before: every n-th."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("__place", place).filter(F.col("__place") % n == 0).withColumn("fired", (F.col("__place") / n).cast("bigint")).drop("__place")


def latest_before(left: DataFrame, right: DataFrame, key: str, ts: str, right_ts: str, value: str) -> DataFrame:
    """As-of join: for each row of left the value of the last row of right of the same key at or before its time.

    Both sides are one sorted stream a key, so no pairs are made.
    """
    union = left.select(key, F.col(ts).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v")).unionByName(
        right.select(key, F.col(right_ts).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("row"), F.col(value).alias("v"))
    )
    w = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn("last", F.last("v", ignorenulls=True).over(w)).filter("side = 1").select("row.*", F.col("last").alias(value))


def cost(tokens: Column, rate: Column) -> Column:
    """USD of tokens at a rate a million; no rate, no cost; a free model costs 0."""
    return F.round(tokens / F.lit(1e6) * rate, 6)


def poisoned_total(ran: Column, usd: Column) -> Column:
    """Sum over passes that ran; null if one of them has no cost."""
    return F.when(F.bool_or(ran & usd.isNull()), F.lit(None)).otherwise(F.round(F.sum(F.when(ran, usd)), 6))


def superseding_ranges(turns: DataFrame, every: int = 5, key: str = "conv_id") -> DataFrame:
    """Extraction ranges of conversations, and those that late turns put in their place: key, range_no, version, first, last, turns, supersedes.

    turns: key, turn and late. Turns in time make a range of every so many, the rest of a conversation its last. A late turn gives
    its range, the last that begins at or before it (the first, if none does), another version, which holds it too and
    names the version that it supersedes. Late turns of a conversation that has no others count as in time. Turns that are null
    are in no range; a turn that comes twice counts twice.
    """
    known = turns.filter(F.col("turn").isNotNull() & F.col(key).isNotNull()).select(key, "turn", F.coalesce("late", F.lit(False)).alias("late"))
    late = F.col("late") & ~F.min("late").over(Window.partitionBy(key))
    known = known.withColumn("late", late)
    number = F.floor((F.row_number().over(Window.partitionBy(key).orderBy("turn")) - 1) / every).cast("bigint")
    base = known.filter("NOT late").withColumn("range_no", number).groupBy(key, "range_no").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("turns"))
    # the range that holds a late turn, as of its number: both are one sorted stream
    begins = base.select(key, F.col("first").alias("turn"), F.lit(0).alias("side"), F.col("range_no").alias("begun"), F.lit(None).cast("bigint").alias("n"))
    numbered = known.filter("late").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("turn")).cast("bigint"))
    asked = numbered.select(key, "turn", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("begun"), "n")
    up_to = Window.partitionBy(key).orderBy("turn", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = begins.unionByName(asked).withColumn("range_no", F.coalesce(F.last("begun", ignorenulls=True).over(up_to), F.lit(0))).filter("side = 1")
    so_far = Window.partitionBy(key, "range_no").orderBy("turn", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select(key, "range_no", F.row_number().over(Window.partitionBy(key, "range_no").orderBy("turn", "n")).cast("bigint").alias("version"), F.min("turn").over(so_far).alias("lo"), F.max("turn").over(so_far).alias("hi"))
    more = placed.join(base, [key, "range_no"]).select(key, "range_no", "version", F.least("first", "lo").alias("first"), F.greatest("last", "hi").alias("last"), (F.col("turns") + F.col("version")).alias("turns"))
    ranges = base.select(key, "range_no", F.lit(0).cast("bigint").alias("version"), "first", "last", "turns").unionByName(more)
    before = F.concat_ws(":", F.col(key), "range_no", (F.col("version") - 1).cast("string"))
    return ranges.withColumn("supersedes", F.when(F.col("version") > 0, before))
