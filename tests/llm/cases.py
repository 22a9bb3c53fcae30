"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
EN = "the cat and the dog of the house that was in the garden with a man"
DE = "der hund und die katze sind in dem haus mit der frau und den kindern nicht"
ROWS = [
    (1, EN, "en", "a"), (2, EN, "en", "a"), (2, EN, "en", "a"), (3, DE, "de", "b"), (4, None, "en", "a"), (5, "", "de", None),
    (6, " \t\n ", None, "b"), (7, LONG, None, "c"), (None, EN + " more", "en", "a"), (None, None, None, None), (8, "42 !! 17", "en", "c"),
    (9, "ünï <|endoftext|> 漢字 😀\r\n\x0bz", "de", "b"), (10, DE.upper(), "de", None), (11, "x", "en", "a"),
]


def odd(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], SCHEMA)
    for name in ("size", "row", "id", "score", "shard", "label", "leader", "held_out", "media", "k1", "word", "bucket", "a.dot", "q_m", "q_measures", "__label", "__row", "__id", "set_key", "taken", "i", "line", "tick`s"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, width: int) -> frozenset:
    w = words((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])


def linked_components(texts: dict[int, str | None], width: int, percent: int) -> dict[int, int]:
    """Smallest id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    at = {i: i for i in texts}

    def root(x: int) -> int:
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    at[y] = x
    return {i: root(i) for i in ids}
