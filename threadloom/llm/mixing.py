"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

A source's documents are shuffled by a hash. A document's virtual finish time is the number of words its source has sent up
to its end, divided by the source's target; a source with a target above its size sends itself again. In order of finish
times, each source has sent its share of the words at any place, so the mix is that order up to the budget. Documents that
are being sent when the budget ends are cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, WORD_BREAK, named, stored, unused, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Running totals are taken in buckets, then over the buckets' sums; the numbers of buckets don't depend on the data.
HASH_DIGITS = 3
TIME_BUCKETS = 16_384


def shuffle_key(key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """Adds weight and target to one row a source with source_size.

    Sources take the weights in turn, by code point, null last. The budget (share of all words) is dealt by weight; what a
    source can't take at max_repeats goes to the others by weight. In order of size by weight, the full sources come first,
    so running sums tell which are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * max_repeats).withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = weighed.withColumn("full", rest * F.col("weight") >= F.col("cap") * weight_left)
    kept = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    level = kept / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "weight", "budget", "target")


def mixed_copies(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0, row: Column | None = None) -> DataFrame:
    """One row for each time a document is sent: row, doc_id, size, source_size, target, repeat, virtual_finish, mix_offset, taken.

    Each row of df has one row with repeat 0 at least, with taken 0 if it isn't in the mix. mix_offset is the number of
    words before the copy in the mix. Null texts have size 0 and are never in the mix; null keys share a shuffle key;
    a null source is a source. Repeated rows count each for itself. Extra columns of df are left out. row: a number that
    tells df's rows apart, if the caller has one.
    """
    rows = stored(df.select((F.monotonically_increasing_id() if row is None else row).alias("row"), named(key).alias("doc_id"), named(source).alias("source"), word_count(named(text)).alias("size"), shuffle_key(named(key), seed).alias("shuffle")))
    rows = rows.withColumn("bucket", F.substring("shuffle", 1, HASH_DIGITS))
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    sizes = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats, share)
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)))
    sums = sums.alias("b").join(sizes.alias("t"), F.expr("b.source <=> t.source")).select("b.source", "bucket", "before", "source_size", "target", "budget")
    in_bucket = Window.partitionBy("r.source", "r.bucket").orderBy("shuffle", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.alias("r").join(sums.alias("s"), F.expr("r.source <=> s.source AND r.bucket = s.bucket"))
    queued = queued.withColumn("sent", F.col("before") + F.sum("size").over(in_bucket)).select("row", "doc_id", "size", "source_size", "target", "budget", "sent", "shuffle")
    repeats = F.least(F.lit(max_repeats), F.greatest(F.lit(1), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))))
    copies = queued.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), repeats.cast("long") - 1)))
    end = F.col("repeat") * F.col("source_size") + F.col("sent")
    served = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.floor("target") - end + F.col("size")))
    copies = copies.withColumn("served", served).withColumn("virtual_finish", F.when(F.col("target") > 0, end / F.col("target")).otherwise(F.lit(1e9)))
    # global order by finish time: ranges of time, their running totals, then the order within a range
    copies = stored(copies.withColumn("span", F.least(F.floor(F.col("virtual_finish") * TIME_BUCKETS), F.lit(TIME_BUCKETS)).cast("int")))
    spans = copies.groupBy("span").agg(F.sum("served").alias("span_served"))
    spans = spans.select("span", F.coalesce(F.sum("span_served").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("span_before"))
    done = Window.partitionBy("span", "salt").orderBy("virtual_finish", "shuffle", "repeat", "row").rowsBetween(Window.unboundedPreceding, -1)
    # what finishes after the budget lies in the last span; it is spread, since it has no order in the mix
    copies = copies.withColumn("salt", F.when(F.col("served") > 0, F.lit(0)).otherwise(F.pmod(F.col("row"), F.lit(4096)).cast("int")))
    placed = copies.join(F.broadcast(spans), "span").withColumn("mix_offset", F.col("span_before") + F.coalesce(F.sum("served").over(done), F.lit(0)))
    room = F.greatest(F.lit(0).cast("long"), F.ceil("budget") - F.col("mix_offset"))
    return placed.select("row", "doc_id", "size", "source_size", "target", "repeat", "virtual_finish", "mix_offset", F.least("served", room).alias("taken"))


def mixed_documents(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as rows of df: each as often as it is sent, the text of one cut at the budget's end up to its last word there.

    Rows are numbered once and stored with their numbers, so that copies find their own text whatever is lost between.
    Null and empty texts are in no mix; an empty table gives none. Columns are those of df, whatever their names.
    """
    row, size, taken = (unused(df, x) for x in ("row", "size", "taken"))
    numbered = stored(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = mixed_copies(numbered, text=text, row=F.col(row), **options).filter("taken > 0").select(F.col("row").alias(row), F.col("size").alias(size), F.col("taken").alias(taken))
    head = F.array_join(F.slice(F.regexp_extract_all(named(text), F.lit(f"{WORD_BREAK[:-1]}*{WORD}"), F.lit(0)), F.lit(1), F.col(taken).cast("int")), "")
    cut = F.when(F.col(taken) < F.col(size), head).otherwise(named(text))
    return numbered.join(copies, row).select(*(cut.alias(c) if c == text else named(c) for c in df.columns))


def mixed(df: DataFrame, **options) -> DataFrame:
    """One row for each row of df: doc_id, size, source_size, target and taken, the words that the mix takes of it.

    Null texts have size 0, null keys and sources count as such, repeated rows each for themselves; an empty table gives none.
    """
    return mixed_copies(df, **options).groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("taken").alias("taken"))
