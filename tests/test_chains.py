from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadloom.operators import chains, items

DAY = dt.datetime(2024, 1, 1)


def test_reasoned_nodes_by_share_of_words(spark):
    nodes = spark.createDataFrame(
        [("a", "A", "Cache the tokens", "slow login", None, None, 3), ("b", "B", "Cache the tokens", "slow login", None, None, 2), ("c", "C", "rotate tokens daily", None, "since caches leak", ["a", "gone", "b"], 0), ("d", "D", "cache tokens login", None, None, None, 5), ("e", "E", None, "tokens", None, None, 4), ("f", "F", "Cache the tokens", "slow login", "", None, 9)],
        "id string, label string, essence string, problem string, logic string, inputs array<string>, quality int",
    )
    queries = spark.createDataFrame([(1, "Tokens, cache! login tokens"), (2, "the a is"), (3, None), (4, "ogi")], "query_id int, text string")
    got = chains.recalled_chains(nodes, queries, 9)
    # c holds "cache" within "caches"; b lacks the quality and d any reason
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "a", 1.0, "slow login"), (1, 2, "f", 1.0, "slow login"), (1, 3, "c", 0.75, "rotate tokens daily"), (1, 4, "e", 0.5, "tokens")]
    assert sorted(tuple(r) for r in chains.premises(got, nodes).collect()) == [(1, 3, 0, "a", "A", "Cache the tokens"), (1, 3, 2, "b", "B", "Cache the tokens")]
    assert chains.recalled_chains(nodes.limit(0), queries).count() == 0


def test_reasoned_texts_of_the_same_words_are_one_class(spark):
    # 600 texts that differ in what no query asks for, and ten queries of the same words
    nodes = spark.range(600).select(F.format_string("n%03d", "id").alias("id"), F.concat_ws(" ", F.lit("token cache"), F.col("id")).alias("essence"), F.when(F.col("id") % 2 == 0, "login").alias("problem"), F.lit(None).cast("string").alias("logic"), F.array(F.lit("a")).alias("inputs"), F.lit(1).alias("quality"))
    queries = spark.range(10).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "token login").otherwise("login, token").alias("text"))
    asked, first = chains.reasoned_classes(nodes, queries, 4)
    assert asked.select("ask").distinct().count() == 1
    assert sorted(r.id for r in first.collect()) == ["n000", "n001", "n002", "n003", "n004", "n005", "n006", "n007"]
    got = chains.recalled_chains(nodes, queries, 4)
    assert sorted((r.query_id, r.place, r.id, r.score) for r in got.collect()) == [(q, p, f"n{2 * p - 2:03d}", 1.0) for q in range(10) for p in range(1, 5)]


def test_terms_of_the_session_before_a_restart(spark):
    time = lambda m: DAY + dt.timedelta(minutes=m)
    log = spark.createDataFrame([(time(10), "Check  LOGIN-flow, tokens"), (time(5), "tokens\tabout cache"), (time(20), None), (time(99), "afterwards")], "at timestamp_ntz, text string")
    nodes = spark.createDataFrame([("app_loginflow", "x", None, time(6)), ("y", "Token", ["caches"], time(21)), ("z", "tokens", None, time(4)), (None, None, ["checks", None], time(22))], "label string, essence string, concepts array<string>, created_at timestamp_ntz")
    start = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    got = sorted(tuple(r) for r in chains.session_terms(log, nodes, start, ["about"]).collect())
    assert got == [("cache", time(5), True), ("check", time(10), False), ("loginflow", time(10), True), ("tokens", time(5), False)]
    assert chains.session_terms(log, nodes, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).count() == 0


def test_second_pass_keeps_what_the_first_knew(spark):
    first = spark.createDataFrame([(1, "a", "fact", "z"), (1, "b", "fact", None), (1, "c", "", "y"), (2, "a", "task", "")], "arc int, id string, type string, extends string")
    second = spark.createDataFrame([(1, "a", "task", None, None, 1), (1, "b", "task", "k", "weak", 2), (1, "c", "task", "", "", 3), (2, "a", "task", "", None, 4), (2, "new", "fact", None, None, 5), (1, "a", "fact", "own", None, 6)], "arc int, id string, type string, extends string, review_reason string, `o.dd` int")
    got = items.prefilled(first, second)
    assert got.columns == second.columns
    assert sorted((r[5], r[3], r[4]) for r in got.collect()) == [(1, "z", "type_override"), (2, "k", "weak"), (3, "y", ""), (4, "", None), (5, None, None), (6, "own", None)]


def test_drifted_blocks_take_unclaimed_items(spark):
    its = spark.createDataFrame([(1, "a", "fact", 1), (1, "b", "fact", 2), (1, "c", "fact", 3), (1, "d", "task", 4), (2, "a", "fact", 1)], "arc int, id string, type string, place int")
    blocks = spark.createDataFrame([(1, 1, "fact", "zz"), (1, 2, "task", "b"), (1, 3, "fact", None), (1, 4, "fact", "qq"), (1, 5, "task", ""), (1, 6, "odd", "zz"), (2, 1, "fact", "b"), (2, 2, None, "a")], "arc int, n int, is_a string, from_item string").withColumns({"known": F.lit(1), "o.dd": F.lit(2)})
    got = sorted(tuple(r) for r in items.recovered(blocks, its).select("arc", "n", "from_item", "drifted").collect())
    # b is claimed by a block of another type, and a in arc 2 by one without a type
    assert got == [(1, 1, "a", True), (1, 2, "b", False), (1, 3, "c", True), (1, 4, "qq", False), (1, 5, "d", True), (1, 6, "zz", False), (2, 1, "b", False), (2, 2, "a", False)]
    assert items.recovered(blocks.limit(0), its).count() == 0
