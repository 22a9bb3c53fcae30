"""What the operators of this subpackage share: word pattern, package shipping, checkpoint tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of a word break: space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch, Spark's default being 10000: whole texts of a batch lie in memory on both sides at once.
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
BREAK_CHARS = " \t\n\x0b\f\r"


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.Array, chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts of a batch in lists of about so many characters, one text at least."""
    part: list[str | None] = []
    size = 0
    for x in batch:
        part.append(x.as_py())
        size += len(part[-1] or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


#: What this process keeps from one task to the next: a vocabulary, or a memory of words seen.
KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make gives, made once a process and key; another key's is dropped, so a worker holds one at a time."""
    if key not in KEPT:
        KEPT.clear()
        pa.default_memory_pool().release_unused()
        KEPT[key] = make()
    return KEPT[key]


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors, once a context, and have Arrow batches of BATCH_ROWS whole texts.

    Python workers of a cluster don't see the driver's folders, so the sources go out as a zip file. A batch size that the
    session has been given is left as it is.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_threadloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="threadloom-")
    name = os.path.join(folder, f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(name, "w") as out:
        for at, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(name)
    sc._threadloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and the master local (tests), under the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/threadloom-checkpoints"
    return f"{base.rstrip('/')}/threadloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, flag: str | None = None, name: str = "table") -> tuple[DataFrame, int]:
    """stored(), and how many rows were written, or of how many the column flag is true; counted while they are written.

    A task that runs again after a loss may be counted again: what is told from the number is only whether it is 0.
    """
    seen = Observation()
    n = F.count(F.lit(1)) if flag is None else F.count_if(F.col(flag))
    return stored(df.observe(seen, n.alias("n")), name), seen.get["n"]


def word_count(text: Column) -> Column:
    """Number of words in text (null: 0), without user functions."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BREAK_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WORD_BREAK))).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
