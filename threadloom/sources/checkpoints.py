"""Tables that cut lineage: written to the folder the cluster shares, and read back."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and the master local (tests), under the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}/threadloom-checkpoints').rstrip('/')}/threadloom-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written and read back; a lost executor costs nothing that was computed before."""
    path = f"{folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_counted(df: DataFrame, flag: str | None = None) -> tuple[DataFrame, int]:
    """settled(), and how many rows were written, or of how many flag is true, counted while they are written.

    A task that runs again after a loss may be counted twice, so only whether the number is 0 is told from it.
    """
    seen = Observation()
    n = F.count(F.lit(1)) if flag is None else F.count_if(F.col(flag))
    return settled(df.observe(seen, n.alias("n"))), seen.get["n"]


def grown(parts: list[tuple[int, DataFrame]], more: DataFrame) -> DataFrame:
    """The union of parts and more, which joins them; eight parts of a rank become one stored part of the next.

    A plan over n rounds so has few inputs, and a row is written again once for each power of eight.
    """
    parts.append((0, more))
    while len(parts) >= 8 and len({rank for rank, _ in parts[-8:]}) == 1:
        rank, last = parts[-1][0], [df for _, df in parts[-8:]]
        parts[-8:] = [(rank + 1, settled(reduce(DataFrame.unionByName, last)))]
    return reduce(DataFrame.unionByName, [df for _, df in parts])
