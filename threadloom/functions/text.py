"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word endings that the stemmer takes off, tried in this order: fixed values.
SUFFIXES = ("ation", "tion", "sion", "ment", "ness", "ity", "age", "ing", "ed", "er", "ion", "al", "ly")


def gist(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where text goes on."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def stem(word: Column) -> Column:
    """The word without the first suffix that fits; words under 4 characters stay, and a final s goes from 5 on."""
    out = F.when(F.length(word) < 4, word)
    for s in SUFFIXES:
        out = out.when(F.endswith(word, F.lit(s)), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.when(F.endswith(word, F.lit("s")) & (F.length(word) > 4), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def terms(text: Column, least: int = 3) -> Column:
    """Distinct words of a-z and 0-9, lower case, of least characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def primary(value: Column) -> Column:
    """A value for comparing: lower case, without quotes and full stops, single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[`\"'.]", ""), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct elements; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def scope_segment(label: Column) -> Column:
    return F.substring_index(label, "_", 1)
