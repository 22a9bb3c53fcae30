"""Joins of points with the intervals they lie in, without comparing a key's points with all its intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a key's bucket that one task takes; buckets of more are dealt to several, with their intervals.
HOT = 50_000


def micros(ts: Column) -> Column:
    """A timestamp as a whole number."""
    return F.unix_micros(ts.cast("timestamp"))


def level(length: Column) -> Column:
    """The least k with 2^k > length, so that an interval of that length lies in two buckets of 2^k at most."""
    return F.when(length <= 0, 0).otherwise(F.length(F.bin(length))).cast("int")


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str = "at", low: str = "low", high: str = "high", hot: int = HOT) -> DataFrame:
    """Every pair of a point and an interval of its key with low <= at <= high, once: the columns of both.

    at, low and high are whole numbers, and no column but the key has the same name on both sides. Each interval lies in at
    most two buckets of a width above its length, whatever that is; points go to one bucket for each width that intervals
    have, 64 at most. Buckets with more than hot points are dealt to several tasks. Null keys and bounds, and intervals that
    end before they begin, match nothing.
    """
    wide = intervals.filter(F.col(key).isNotNull() & (F.col(low) <= F.col(high))).withColumn("__level", level(F.col(high) - F.col(low)))
    levels = sorted(r[0] for r in wide.select("__level").distinct().collect())
    if not levels:
        return points.join(intervals.limit(0), key)
    bucket = lambda x, k: F.call_function("shiftright", x.cast("bigint"), k)
    spots = points.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    spots = spots.withColumn("__bucket", bucket(F.col(at), F.col("__level")))
    spans = wide.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col(low), F.col("__level")), bucket(F.col(high), F.col("__level"))))))
    place = [key, "__level", "__bucket"]
    deals = spots.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("__deals")).filter("__deals > 1")
    spots = spots.join(deals, place, "left").withColumn("__deal", F.floor(F.rand(7) * F.coalesce("__deals", F.lit(1))).cast("int")).drop("__deals")
    spans = spans.join(deals, place, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), F.coalesce("__deals", F.lit(1)) - 1))).drop("__deals")
    met = spots.join(spans, [*place, "__deal"]).filter((F.col(low) <= F.col(at)) & (F.col(at) <= F.col(high)))
    return met.drop("__level", "__bucket", "__deal")
