"""Recall of reasoned nodes with their premises, and what a session asked for and did not save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import settled
from .grams import contained
from .reads import top_in_group


def long_words(text: Column, least: int) -> Column:
    """Lower-case words of a-z, 0-9 and _ of at least so many characters, repeats included."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]", " "), " +"), lambda w: F.length(w) >= least)


def _words(texts: DataFrame, *keys: str) -> DataFrame:
    """Distinct words between white space of string, with the keys. What has no white space is in a text if it is in one of these."""
    return texts.select(*keys, F.explode(F.array_distinct(F.split("string", r"\s+"))).alias("word")).filter("word <> ''").distinct()


def reasoned_classes(nodes: DataFrame, queries: DataFrame, limit: int, quality: int = 3) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, ask, words) and the first limit nodes of each class (class, needles, id, place), both stored.

    Queries of the same long words, repeats included, are one ask. Reasoned nodes whose texts contain the same of all queries' words are one class;
    those that contain none are left out.
    """
    counts = F.col("inputs").isNotNull() | ((F.coalesce("problem", F.lit("")) != "") & (F.col("quality") >= quality))
    texts = nodes.filter(counts).select("id", F.lower(F.concat_ws(" ", F.nullif("essence", F.lit("")), F.nullif("problem", F.lit("")), F.nullif("logic", F.lit("")))).alias("string"))
    texts = texts.withColumn("key", F.sha2("string", 256))
    asked = queries.select("query_id", F.array_sort(long_words(F.col("text"), 4)).alias("words")).filter(F.size("words") > 0)
    asked = settled(asked.withColumn("ask", F.sha2(F.concat_ws(" ", "words"), 256)))
    # of each text its few nodes, so that a text is taken apart once however many nodes share it
    first = settled(top_in_group(texts, ["key"], [F.col("id")], limit).drop("place"))
    there = settled(_words(first.groupBy("key").agg(F.first("string").alias("string")), "key"))
    needles = asked.select(F.explode(F.array_distinct("words")).alias("needle"))
    hits = contained(needles, there, string="word").withColumnRenamed("string", "word").join(there, "word").select("needle", "key").distinct()
    held = hits.groupBy("key").agg(F.array_sort(F.collect_list("needle")).alias("needles")).withColumn("class", F.sha2(F.concat_ws(" ", "needles"), 256))
    return asked, settled(top_in_group(first.join(held, "key").select("class", "needles", "id"), ["class"], [F.col("id")], limit))


def recalled_chains(nodes: DataFrame, queries: DataFrame, limit: int = 2, quality: int = 3) -> DataFrame:
    """For each query (query_id, text) the limit (four at most) best reasoned nodes: query_id, place, id, score and problem.

    nodes: id, essence, problem, logic (null: none), inputs (array, null: not derived) and quality. A node counts if it is derived, or names a problem and has the
    quality. Its score is the share of the query's words of four letters or more that its essence, problem or logic contain; nodes without any
    are left out, and of equal scores the smaller id comes first. A null text has no words. Texts that contain the same of all queries' words
    score the same, so they are scored as one class, of which only the first few nodes can be among the best; queries of the same words are asked once.
    """
    limit = min(limit, 4)
    asked, first = reasoned_classes(nodes, queries, limit, quality)
    asks = asked.groupBy("ask").agg(F.first("words").alias("words"))
    words = asks.select("ask", F.size("words").alias("all"), F.explode("words").alias("needle")).groupBy("ask", "all", "needle").agg(F.count("*").alias("m"))
    classes = first.filter("place = 1").select("class", F.col("id").alias("least"), F.explode("needles").alias("needle"))
    scored = words.join(classes, "needle").groupBy("ask", "all", "class", "least").agg(F.sum("m").alias("m")).select("ask", "class", "least", (F.col("m") / F.col("all")).alias("score"))
    # a class that so many precede by score and smallest id has no node among the best
    ahead = top_in_group(scored, ["ask"], [F.desc("score"), F.col("least")], limit).select("ask", "class", "score")
    best = top_in_group(ahead.join(first.select("class", "id"), "class").drop("class"), ["ask"], [F.desc("score"), F.col("id")], limit)
    best = asked.select("query_id", "ask").join(best, "ask").drop("ask")
    about = nodes.select("id", F.coalesce(F.nullif("problem", F.lit("")), F.substring("essence", 1, 80)).alias("problem"))
    return best.join(about, "id").select("query_id", "place", "id", "score", "problem")


def premises(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """The inputs of recalled nodes in order: query_id, place, step, id, label and a hundred characters of the essence; unknown inputs are left out."""
    steps = chains.join(nodes.select("id", "inputs"), "id").select("query_id", "place", F.posexplode("inputs").alias("step", "id"))
    return steps.join(nodes.select("id", "label", F.substring("essence", 1, 100).alias("essence")), "id").select("query_id", "place", "step", "id", "label", "essence")


def session_terms(log: DataFrame, nodes: DataFrame, start: Column, stop: list[str] = (), after: int = 60) -> DataFrame:
    """What was asked before a restart, and whether it was saved meanwhile: term, asked (first time) and covered.

    log: at and text. Terms are words of five letters or more that are no stop words, letters of other alphabets and signs left out. A term is covered if the label, the essence or a
    concept of a node contains it that was made between the first query and so many seconds after the last one before start. Without queries there are no rows.
    """
    before = log.filter(F.col("at") < start)
    span = before.agg(F.min("at").alias("from"), (F.max("at") + F.make_dt_interval(secs=F.lit(after))).alias("to"))
    words = before.select("at", F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("w")).select("at", F.lower(F.regexp_replace("w", "[^A-Za-z0-9_]", "")).alias("term"))
    asked = words.filter((F.length("term") > 4) & ~F.col("term").isin(*stop) if stop else F.length("term") > 4).groupBy("term").agg(F.min("at").alias("asked"))
    # one row
    saved = nodes.join(F.broadcast(span), F.col("created_at").between(F.col("from"), F.col("to")))
    said = saved.select(F.explode(F.concat(F.array("label", "essence"), F.coalesce("concepts", F.array().cast("array<string>")))).alias("string")).select(F.lower("string").alias("string"))
    found = contained(asked.select(F.col("term").alias("needle")), _words(said), string="word").select(F.col("needle").alias("term")).distinct().withColumn("covered", F.lit(True))
    return asked.join(found, "term", "left").select("term", "asked", F.coalesce("covered", F.lit(False)).alias("covered"))
