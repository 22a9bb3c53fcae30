"""Quality rules: a table of thresholds over text ratios, compiled into one projection without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BREAK_CHARS, WORD_BREAK, named, unused

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of English, French, German and Spanish, which running text of any length has.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec dans de des du elle en est et la le les ne pas pour que qui sur un une "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "al como con del el en es la las lo los no para por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """A document fails where metric lies outside low to high; from_words: shorter texts are not held against it."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 16.0, 10),
    Rule("symbols", "symbols_per_word", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.02, None, 50),
    Rule("line_repeats", "dup_line_ratio", None, 0.4, 10),
    Rule("capitals", "capital_ratio", None, 0.6, 10),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BREAK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of five words found twice or more in the text.

    Windows stand as 64-bit hashes. Texts whose windows all differ, which a hash set tells, are done; of others, the
    sorted (hash, place) pairs show the repeated places, and each counts the words up to the next one, five at most.
    """

    def covered(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        gaps = let(let(pairs, places), lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)

    def counted(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(counted(words))


def measures(text: Column) -> Column:
    """Struct of counts over one text."""
    whole = F.coalesce(text, F.lit(""))
    stop = sorted(set(STOP_WORDS.split()))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BREAK_CHARS)) != "")

    def over_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(F.length(F.array_join(w, "")), F.lit(0)).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
        )

    return F.struct(
        let(words_of(whole), over_words).alias("w"),
        (F.length(whole) - F.length(F.regexp_replace(whole, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.regexp_replace(whole, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_capitals")


def compiled(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> list[Column]:
    """A boolean column fail_<rule> for each rule, from the count columns."""
    c = {n: F.col(prefix + n) for n in COUNTS}
    one = F.lit(1)
    ratio = {
        "n_words": c["n_words"],
        "mean_word_chars": c["word_chars"] / F.greatest(c["n_words"], one),
        "symbols_per_word": c["n_symbols"] / F.greatest(c["n_words"], one),
        "stop_word_ratio": c["n_stop_words"] / F.greatest(c["n_words"], one),
        "dup_line_ratio": c["n_dup_lines"] / F.greatest(c["n_lines"], one),
        "repeat_word_ratio": c["n_repeat_words"] / F.greatest(c["n_words"], one),
        "capital_ratio": c["n_capitals"] / F.greatest(c["word_chars"], one),
    }
    out = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad |= ratio[r.metric] < F.lit(r.low)
        if r.high is not None:
            bad |= ratio[r.metric] > F.lit(r.high)
        out.append((bad & (c["n_words"] >= r.from_words)).alias(f"{prefix}fail_{r.name}"))
    return out


def with_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "q_") -> DataFrame:
    """df with its counts, base_failed, a column fail_<rule> a rule, and kept, all under prefix.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. kept: neither base_failed nor any
    rule failed. Null and empty texts have no words and are not kept. Rows stay as they are, repeated ones too; columns
    that bear a new column's name are replaced; an empty table gives none.
    """
    m = unused(df, f"{prefix}measures")
    found = df.withColumn(m, measures(named(text)))
    flat = {n: F.col(m)["w"][n] for n in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")} | {n: F.col(m)[n] for n in ("n_symbols", "n_capitals")} | {n: F.col(m)["l"][n] for n in ("n_lines", "n_dup_lines")}
    found = found.withColumns({prefix + n: c for n, c in flat.items()}).drop(m)
    base = (F.col(f"{prefix}n_words") < 10) | (F.col(f"{prefix}n_repeat_words") * 100 > F.col(f"{prefix}n_words") * 20)
    checks = compiled(rules, prefix)
    names = [f"{prefix}fail_{r.name}" for r in rules]
    found = found.withColumns({f"{prefix}base_failed": base, **dict(zip(names, checks, strict=True))})
    good = ~F.col(f"{prefix}base_failed")
    for n in names:
        good &= ~F.col(n)
    return found.withColumn(f"{prefix}kept", good)
