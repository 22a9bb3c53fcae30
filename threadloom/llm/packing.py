"""Packing token pieces into sequences of equal length by Karmarkar-Karp multiway differencing.

Every partition of the input packs its own pieces, a group of at most GROUP at a time, so nothing is shuffled and a lost
task is simply run again. In a group each piece starts as a partition of its own into k windows, all but one empty. The two
partial partitions with the largest spreads are merged, the fullest windows of one with the emptiest of the other, until one
is left. If a window of it is over capacity, the group is packed anew with one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import tokens_of, vocabulary_path
from .shared import named, ship_package

CAPACITY = 1024
#: What a document has over full sequences is cut into near equal pieces of at most so many tokens.
PIECE = 256
#: Pieces that are packed together.
GROUP = 1024


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each size, 0 to k - 1, by multiway differencing."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # A partial partition: window sums in falling order less the least of them; of a single piece only the first is not 0.
    # merged[j]: the two it was made of, and for each of its windows the window of either that went into it.
    heap = [(-int(s), j) for j, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merged: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    down = np.arange(k)

    def vector(j: int) -> np.ndarray:
        if j >= n:
            return sums.pop(j)
        v = np.zeros(k, np.int64)
        v[0] = sizes[j]
        return v

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vector(a) + vector(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        j = n + len(merged)
        merged.append((a, b, order, down[::-1][order]))
        sums[j] = total
        heapq.heappush(heap, (-int(total[0]), j))
    out = np.zeros(n, np.int64)
    # downwards from the last: the final window of each window of a partial partition
    final = {heap[0][1]: down}
    for j in range(len(merged) - 1, -1, -1):
        a, b, of_a, of_b = merged[j]
        where = final.pop(n + j)
        for child, windows in ((a, of_a), (b, of_b)):
            if child < n:
                out[child] = where[np.flatnonzero(windows == 0)[0]]
            else:
                mine = np.empty(k, np.int64)
                mine[windows] = where
                final[child] = mine
    return out


def least_windows(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    return max(1, -(-int(sizes.sum()) // capacity))


def windows(sizes: np.ndarray, capacity: int = CAPACITY, spare: int = 0) -> np.ndarray:
    """Window of each size with no window over capacity.

    The number of windows starts spare above the least possible and rises by one whenever a window is over capacity.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("a piece is larger than a window")
    k = least_windows(sizes, capacity) + spare
    while True:
        found = differenced(sizes, k)
        load = np.bincount(found, sizes, k)
        if load.max() <= capacity:
            return found
        k += 1


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> tuple[int, list[int]]:
    """How many full sequences n tokens give, and the lengths of the pieces of the rest, one at most apart."""
    whole, rest = divmod(n, capacity)
    parts = -(-rest // piece)
    return whole, [rest // parts + (j < rest % parts) for j in range(parts)]


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tokens array<int>"


def packed(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY, with_tokens: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_tokens its tokens.

    A document is its token ids and end_id, so null and empty texts are one id and every row of df has a piece at least.
    Repeated rows are packed each for itself. Sequence ids hold the task's number above 40 bits, so they are unique and the
    same whenever the input's partitions are. Extra columns of df are left out; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    schema = SCHEMA if with_tokens else SCHEMA.removesuffix(", tokens array<int>")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens_of(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        done: list[tuple] = []
        held = spare = 0

        def settle() -> None:
            nonlocal sequence, spare
            sizes = np.array([p[2] for p in waiting], np.int64)
            # groups of one partition are alike: one window less than the last needed, in proportion, is where to begin
            least = least_windows(sizes, capacity)
            found = windows(sizes, capacity, max(0, spare * len(sizes) // GROUP - 1))
            if len(sizes) == GROUP:
                spare = int(found.max()) + 1 - least
            order = np.argsort(found, kind="stable")
            ends = np.cumsum(sizes[order])
            first = np.searchsorted(found[order], found[order])
            before = ends - sizes[order]
            for at, j in enumerate(order):
                done.append((*waiting[j][:5], sequence + int(found[j]), int(before[at] - before[first[at]]), *waiting[j][5:]))
            sequence += int(found.max()) + 1 if len(found) else 0
            waiting.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([p[c] for p in done], pa.int64()) for c in range(7)]
            if with_tokens:
                columns.append(pa.array([p[7] for p in done], pa.list_(pa.int32())))
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*names, *["tokens"] * with_tokens])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 256):
                for doc, ids in zip(keys[at : at + 256], encoder.encode(batch.column(1)[at : at + 256].to_pylist()), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    whole, parts = cuts(len(ids), capacity)
                    start = 0
                    for length in [capacity] * whole + parts:
                        part = ids[start : start + length]
                        piece = (doc, start, length, zlib.crc32(part.tobytes()), len(ids), *([part.astype(np.int32)] if with_tokens else []))
                        if length == capacity:
                            done.append((*piece[:5], sequence, 0, *piece[5:]))
                            sequence += 1
                        else:
                            waiting.append(piece)
                        start += length
                        if len(waiting) >= GROUP:
                            settle()
                        held += length
                        if held >= 2_000_000:
                            yield flush()
                            held = 0
        if waiting:
            settle()
        yield flush()

    return df.select(named(key).cast("long").alias("doc_id"), named(text).alias("text")).mapInArrow(pack, schema)
