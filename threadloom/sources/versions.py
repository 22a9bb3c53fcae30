"""Tables in hash buckets of which each version shares the files of buckets that no write has touched.

Rows lie in data/made=<version>/bucket=<number>; versions/<version> says for every bucket in which version it was made. A write
makes the touched buckets anew and then the list, which is what makes it hold: a write that stops before leaves the table as
it was, and running it again replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketedTable:
    """A table under folder, in buckets by the hash of one column."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def latest(self) -> int:
        """The number of the last version, 0 if there is none."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.folder}/versions")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit() and fs.exists(jvm.Path(f"{self.folder}/versions/{n}/_SUCCESS"))), default=0)

    def made(self, version: int) -> dict[int, int]:
        """In which version each bucket that has rows was made."""
        return {r.bucket: r.made for r in self.spark.read.parquet(f"{self.folder}/versions/{version}").collect() if r.bucket >= 0}

    def batches(self, version: int) -> set[str]:
        return {r.batch for r in self.spark.read.parquet(f"{self.folder}/versions/{version}").filter("batch IS NOT NULL").collect()}

    def taken(self, batch: str | None) -> bool:
        """Whether the last version has taken this batch in; a batch without a name never is."""
        return batch is not None and batch in self.batches(self.latest())

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        return self._write(rows, 1, {}, set(range(self.buckets)), set())

    def _write(self, rows: DataFrame, version: int, made: dict[int, int], touched: set[int], batches: set[str]) -> int:
        # a task holds whole buckets, so each has one file
        dealt = rows.withColumn("bucket", self.bucket(self.key)).repartition(min(self.buckets, max(1, len(touched))), "bucket")
        dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/data/made={version}")
        there = {r.bucket for r in self.spark.read.schema("bucket int").parquet(f"{self.folder}/data/made={version}").select("bucket").distinct().collect()}
        return self._list(version, {b: m for b, m in made.items() if b not in touched} | dict.fromkeys(there, version), batches)

    def _list(self, version: int, now: dict[int, int], batches: set[str]) -> int:
        listed = [(b, m, None) for b, m in sorted(now.items())] + [(-1, version, x) for x in sorted(batches)] or [(-1, version, None)]
        self.spark.createDataFrame(listed, "bucket int, made int, batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{version}")
        return version

    def read(self, schema: object, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or only those of some buckets."""
        version = version or self.latest()
        paths = [f"{self.folder}/data/made={m}/bucket={b}" for b, m in sorted(self.made(version).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rewrite(self, schema: object, touched: DataFrame, change: Callable[[DataFrame], DataFrame], batch: str | None = None) -> int:
        """The next version, in which the buckets of the keys of touched are what change makes of their rows.

        A batch that some version has taken in already changes nothing; one that touches no bucket is taken in all the same. change
        sees whole buckets and must not move rows to others.
        """
        version = self.latest()
        batches = self.batches(version)
        if batch is not None and batch in batches:
            return version
        numbers = {r[0] for r in touched.select(self.bucket(self.key).alias("b")).distinct().collect()}
        if not numbers:
            return version if batch is None else self._list(version + 1, self.made(version), batches | {batch})
        after = change(self.read(schema, version, numbers))
        return self._write(after, version + 1, self.made(version), numbers, batches | ({batch} if batch else set()))
