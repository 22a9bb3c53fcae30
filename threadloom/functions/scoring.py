"""Scores: recency decay and cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decay a day by time to live: fixed values.
DECAY = {"session": 2.0, "1hr": 1.0, "24hr": 0.5, "1week": 0.1, "project": 0.01, "permanent": 0.001}


def recency(updated: Column, ttl: Column, now: Column) -> Column:
    """1 / (1 + days * rate of the ttl)."""
    rates = F.create_map(*(F.lit(x) for pair in DECAY.items() for x in pair))
    days = F.timestamp_diff("SECOND", updated, now) / F.lit(86400.0)
    return 1 / (1 + days * F.coalesce(F.element_at(rates, ttl), F.lit(0.1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for nulls, empty or unequal lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)
