"""Conversation turns, sticky goals and usage ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters kept of a turn by role, and the fewest that make a turn.
CLIP = {"user": 2000}
CLIP_OTHER = 16000
LEAST_CHARS = 10


def normalised(turns: DataFrame) -> DataFrame:
    """Turns with their text trimmed and clipped by role; those under LEAST_CHARS go."""
    keep = F.lit(CLIP_OTHER)
    for role, n in CLIP.items():
        keep = F.when(F.col("role") == role, F.lit(n)).otherwise(keep)
    clipped = turns.withColumn("text", F.substring(F.trim("text"), F.lit(1), keep))
    return clipped.filter(F.length("text") >= LEAST_CHARS)


def goals(spark: SparkSession, path: str) -> DataFrame:
    """KEY: value lines of text files, the key in lower case; other lines are left out."""
    pattern = r"^\s*([A-Za-z][A-Za-z _-]*):\s*(.+?)\s*$"
    return spark.read.text(path).select(F.lower(F.regexp_extract("value", pattern, 1)).alias("key"), F.regexp_extract("value", pattern, 2).alias("goal")).filter("key <> ''")


LEDGER = "ts timestamp, model string, input bigint, output bigint, thinking bigint, cost_usd double, cost_source string, wall_ms bigint"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Usage records of JSON lines; malformed lines are left out."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)
