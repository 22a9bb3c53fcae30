"""Which strings contain which others, by an inverted index of grams instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import settled
from .reads import top_in_group

#: Characters of a gram; shorter needles are looked up by grams of their own length.
GRAM = 3


def grams(text: Column, size: Column | int = GRAM) -> Column:
    """Distinct substrings of size characters, none of shorter texts."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, size)))


def contained(needles: DataFrame, strings: DataFrame, needle: str = "needle", string: str = "string") -> DataFrame:
    """Distinct pairs (needle, string) of which the string contains the needle.

    A needle is looked up by the rarest of its grams among the strings, and what that gives is checked. Null and empty
    needles and null strings match nothing. Strings are told apart by themselves, so many rows of one string cost nothing.
    """
    wanted = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct().withColumn("size", F.least(F.lit(GRAM), F.length("needle")))
    there = strings.select(F.col(string).alias("string")).filter("string IS NOT NULL").distinct()
    keys = wanted.withColumn("gram", F.explode(grams(F.col("needle"), F.col("size"))))
    # grams of sizes that no needle is looked up by are not made
    posted = there.crossJoin(F.broadcast(wanted.select("size").distinct())).withColumn("gram", F.explode(grams(F.col("string"), F.col("size"))))
    # counted and looked up: grams are taken apart once
    posted = settled(posted.join(keys.select("gram").distinct(), "gram", "left_semi").select("gram", "string"))
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no string has rules its needle out
    rarest = keys.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return rarest.filter("best.n > 0").select("needle", F.col("best.gram").alias("gram")).join(posted, "gram").filter(F.contains("string", "needle")).select("needle", "string")


def similar_tags(tags: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """tag, known and place: of the known tags those that begin like a tag (five characters) or hold the other's first six.

    tags: tag; known: known. The first by spelling count, most a tag, itself excepted. Of what shares one beginning only the
    first few can be among these, so no group of tags meets another in full.
    """
    mine = tags.select("tag").distinct()
    theirs = known.select("known").distinct()
    first = lambda df, group: top_in_group(df, group, [F.col("known")], most + 1).drop("place")
    head = lambda c, n: F.substring(c, 1, n)
    alike = first(theirs.filter(F.length("known") >= 5).select(head("known", 5).alias("head"), "known"), ["head"])
    by_head = mine.filter(F.length("tag") >= 5).withColumn("head", head("tag", 5)).join(alike, "head").select("tag", "known")
    holds = contained(mine.select(head("tag", 6).alias("needle")), theirs.select(F.col("known").alias("string"))).withColumnRenamed("string", "known")
    by_mine = mine.withColumn("needle", head("tag", 6)).join(first(holds, ["needle"]), "needle").select("tag", "known")
    held = contained(theirs.select(head("known", 6).alias("needle")), mine.select(F.col("tag").alias("string")))
    by_theirs = held.join(first(theirs.select(head("known", 6).alias("needle"), "known"), ["needle"]), "needle").select(F.col("string").alias("tag"), "known")
    found = by_head.unionByName(by_mine).unionByName(by_theirs).filter("tag <> known").distinct()
    return top_in_group(found, ["tag"], [F.col("known")], most)
