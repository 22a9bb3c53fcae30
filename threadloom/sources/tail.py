"""A streaming source that tails growing text files line by line, with a byte position for each file as its offset.

Only whole lines are taken: what follows the last line break waits. A file that has shrunk, or begins with other bytes than
before, is a new file and read from its start. A file that can't be read, or is gone for a while, keeps its position; over a
restart it does so by the cursor, a file that holds the positions last handed out. Spark keeps the offsets in the query's checkpoint, and a batch that failed is read again from its offsets, so lines come
at least once.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .shipping import shipped

#: First bytes by which a file is known again, bytes read at once when looking for the last line break, bytes of a task.
HEAD = 256
STEP = 1 << 16
PART = 32 << 20
LINES = 5_000


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [low, high); first says that low is the start of a line."""

    path: str
    low: int
    high: int
    end: int
    first: bool


def whole_lines(path: str, size: int, low: int) -> int:
    """The position after the last line break of the first size bytes; low if there is none behind it."""
    with open(path, "rb") as f:
        at = size
        while at > low:
            step = min(STEP, at - low)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
    return low


def head_of(path: str, length: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(length))


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, cursor: str | None = None) -> None:
        self.folder, self.suffix, self.cursor = folder, suffix, cursor
        self.known: dict[str, list[int]] = {}
        if cursor and os.path.exists(cursor):
            with open(cursor) as f:
                self.known = json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def place(self, path: str, before: list[int] | None) -> list[int]:
        """Position, and length and checksum of the head, of a file that was at before."""
        size = os.path.getsize(path)
        at, head, check = before or [0, 0, 0]
        if size < at or head_of(path, head) != check:
            at, head, check = 0, 0, 0
        at = whole_lines(path, size, at)
        # a head that was short is taken again when the file is longer
        if head < HEAD and at > head:
            head = min(HEAD, at)
            check = head_of(path, head)
        return [at, head, check]

    def latestOffset(self) -> dict:  # noqa: N802
        there = {os.path.join(at, f) for at, _, files in os.walk(self.folder) for f in files if f.endswith(self.suffix)}
        for path in sorted(there):
            try:
                self.known[path] = self.place(path, self.known.get(path))
            except OSError:
                # held where it is; a file that was never read has no position yet
                continue
        return {k: list(v) for k, v in sorted(self.known.items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.cursor:
            with open(f"{self.cursor}.new", "w") as f:
                json.dump(end, f)
            os.replace(f"{self.cursor}.new", self.cursor)
        out: list[InputPartition] = []
        for path, (high, _, _) in sorted(end.items()):
            low, head, check = start.get(path, [0, 0, 0])
            if high != low and (high < low or head_of(path, head) != check):
                low = 0
            out += [Range(path, a, min(a + PART, high), high, a == low) for a in range(low, high, PART)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["path", "position", "line"]
        at: list[int] = []
        lines: list[str] = []
        with open(partition.path, "rb") as f:
            f.seek(partition.low if partition.first else partition.low - 1)
            if not partition.first:
                # the line that the part before has begun
                f.readline()
            while (position := f.tell()) < partition.high and (line := f.readline()):
                text = line.rstrip(b"\r\n")
                if text:
                    at.append(position)
                    lines.append(text.decode("utf-8", "replace"))
                if len(at) >= LINES:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(at)), pa.array(at, pa.int64()), pa.array(lines)], names=names)
                    at, lines = [], []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(at)), pa.array(at, pa.int64()), pa.array(lines)], names=names)

    def commit(self, end: dict) -> None:
        for path, place in end.items():
            self.known.setdefault(path, list(place))


class TailSource(DataSource):
    """Options: path, a folder that driver and executors see under one name, suffix (.jsonl) and cursor (a file that the driver writes)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, position bigint, line string"

    def streamReader(self, schema: object) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"), self.options.get("cursor"))


def tailed(spark: SparkSession, folder: str, suffix: str = ".jsonl", cursor: str | None = None) -> DataFrame:
    """The lines of a folder's files as they grow: path, position (of the line's first byte) and line.

    Without a cursor a file that is gone while the query starts again is read from its start when it comes back.
    """
    shipped(spark)
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("tail").option("suffix", suffix)
    return (stream.option("cursor", cursor) if cursor else stream).load(folder)
