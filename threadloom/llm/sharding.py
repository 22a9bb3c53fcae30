"""Shards by fixed virtual slots and a stored, versioned slot-to-shard map.

A record's slot is a hash and never changes. What changes is the map: a table of N_SLOTS rows, one folder a version. A new
version is the old one with a few slots moved, so only the records of those slots move.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import named, shared_folder

#: The map has as many rows at any size of the data, so the driver may hold it and Spark may broadcast it.
N_SLOTS = 8192
#: Bytes of a record besides its text.
RECORD_OVERHEAD = 16

MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long, first_row long"

Sizes = dict[int, tuple[int, int]]


def with_slots(df: DataFrame, text: str = "text", key: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """key, size, text_crc32 and virtual_slot of every record; null texts have no bytes and the checksum of none.

    The hash is over key and text, so records without a key spread, and so do the copies of a text, which are not kept
    together. Rows repeated with key and text share a slot.
    """
    whole = F.coalesce(named(text), F.lit(""))
    return df.select(
        named(key),
        (F.octet_length(whole) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.pmod(F.xxhash64(named(key), named(text)), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(slotted: DataFrame) -> Sizes:
    """Bytes and records of each slot: at most one row a slot reaches the driver."""
    rows = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in rows}


def first_map(sizes: Sizes, n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Shard of each slot: the largest slots first, each to the shard with the fewest bytes."""
    load = [(0, 0, s) for s in range(n_shards)]
    shard = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda k: (-sizes.get(k, (0, 0))[0], k)):
        b, n, s = heapq.heappop(load)
        shard[slot] = s
        heapq.heappush(load, (b + sizes.get(slot, (0, 0))[0], n + 1, s))
    return shard


def rebalanced(shard: list[int], sizes: Sizes, n_shards: int, tolerance: float = 0.01) -> list[int]:
    """The map edited for new sizes or more shards, by few moves.

    The fullest shard that can gives the slot that leaves it and the emptiest nearest to each other, until all are within
    tolerance of the mean above the emptiest or no move helps.
    """
    shard = list(shard)
    weight = [sizes.get(k, (0, 0))[0] for k in range(len(shard))]
    load = [0] * n_shards
    members: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, s in enumerate(shard):
        load[s] += weight[slot]
        members[s].append(slot)
    mean = sum(load) / n_shards
    for _ in range(len(shard)):
        low = min(range(n_shards), key=lambda s: (load[s], s))
        fits: list[int] = []
        for top in sorted(range(n_shards), key=lambda s: (-load[s], s)):
            if load[top] - load[low] <= tolerance * mean:
                break
            # the move that leaves the two nearest to each other; a shard of one large slot has none to give
            fits = [k for k in members[top] if 0 < weight[k] < load[top] - load[low]]
            if fits:
                break
        if not fits:
            break
        best = min(fits, key=lambda k: (abs(load[top] - load[low] - 2 * weight[k]), k))
        members[top].remove(best)
        members[low].append(best)
        load[top] -= weight[best]
        load[low] += weight[best]
        shard[best] = low
    return shard


class SlotMaps:
    """The versions of a slot-to-shard map in a folder: version=1, 2, ..."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/slot_maps"

    def write(self, version: int, shard: list[int], sizes: Sizes) -> None:
        """Slots with their shard, size and the number of records of earlier slots in the shard."""
        first: dict[int, int] = {}
        rows = []
        for slot, s in enumerate(shard):
            b, n = sizes.get(slot, (0, 0))
            rows.append((slot, s, b, n, first.get(s, 0)))
            first[s] = first.get(s, 0) + n
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.folder}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.folder}/version={version}")

    def latest(self) -> int:
        """The newest version in the folder, 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
        return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)

    def edited(self, version: int, sizes: Sizes, n_shards: int) -> int:
        """Writes the next version: the given one, edited for new sizes or another number of shards; its number."""
        old = [r.shard for r in self.read(version).orderBy("virtual_slot").collect()]
        self.write(version + 1, rebalanced(old, sizes, n_shards), sizes)
        return version + 1


def assigned(slotted: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every record with its shard and its place there, gapless from 0. Equal records stand next to each other."""
    place = Window.partitionBy("virtual_slot").orderBy(named(key).asc_nulls_last(), "text_crc32", "size")
    return slotted.join(F.broadcast(slot_map), "virtual_slot").withColumn("slot", F.col("first_row") + F.row_number().over(place) - 1)


def sharded(df: DataFrame, n_shards: int = 40, text: str = "text", key: str = "doc_id", folder: str | None = None, then_shards: int | None = None) -> DataFrame:
    """df's records in shards of near equal bytes, under the map in folder.

    A folder without a map gets version 1; one with a map gets a next version, edited for the sizes found now, so few
    records change shards. Without a folder the map is a new one. With then_shards one more version is written, edited for
    so many shards, and next_shard is where a record would then be. An empty table gives no rows. A record is never split:
    where one is larger than a shard's mean, its shard is larger. Extra columns of df are left out.
    """
    slotted = with_slots(df, text, key)
    sizes = slot_sizes(slotted)
    maps = SlotMaps(df.sparkSession, folder)
    version = maps.latest() if folder else 0
    if version:
        version = maps.edited(version, sizes, n_shards)
    else:
        version = 1
        maps.write(version, first_map(sizes, n_shards), sizes)
    rows = assigned(slotted, maps.read(version), key)
    if then_shards is None:
        return rows
    after = maps.read(maps.edited(version, sizes, then_shards)).select("virtual_slot", F.col("shard").alias("next_shard"))
    return rows.join(F.broadcast(after), "virtual_slot")
