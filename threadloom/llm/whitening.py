"""Whitening of vectors by a tall-skinny QR.

Entries become whole numbers, so sums are exact and each row is centred by the exact mean before anything is multiplied. Every
partition reduces its centred rows to the triangular factor of their QR; factors are merged FAN at a time, a stored level of
the tree after the other, until one is left. Its singular value decomposition gives the right vectors that whiten. No
covariance is formed, which would square the condition number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, ship_package, stored, unused

#: Whole steps to one.
SCALE = 256.0
#: Factors or moments that one task merges.
FAN = 16
#: Rows that are reduced at once.
CHUNK = 2048
#: Low bits that are summed apart from the high ones, so that sums of longs stay exact.
LOW = 24
LIMIT = 2.0**62


@dataclass(frozen=True)
class Model:
    """A fitted whitening: size of the fit list, exact sums, components (rows), variances and the share each explains."""

    dims: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def entries(vectors: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Lengths (-1: not usable), all entries end to end as doubles, and where each vector begins.

    Not usable are null and empty vectors and those with null, non-finite or unrepresentable entries.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~(np.abs(flat) * SCALE < LIMIT)
    missed = np.concatenate([[0], np.cumsum(bad)])
    lengths = np.diff(ends)
    good = np.asarray(vectors.is_valid()) & (lengths > 0) & (missed[ends[1:]] == missed[ends[:-1]])
    return np.where(good, lengths, -1).tolist(), flat, ends[:-1]


def whole(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, dims: int) -> np.ndarray:
    """The chosen rows as whole numbers."""
    at = starts[rows][:, None] + np.arange(dims)
    return np.floor(flat[at] * SCALE).astype(np.int64)


def usual_length(df: DataFrame, vector: str) -> int:
    """The length that most usable vectors have, of equals the longest; 0 if there is none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(entries(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["dims", "n"])

    best = df.select(named(vector)).mapInArrow(count, "dims bigint, n bigint").filter("dims > 0").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return best.dims if best else 0


def fit_list(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Every distinct vector of whole numbers once, as bytes; copies within a batch go before the shuffle."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat, starts = entries(batch.column(0))
            rows = np.flatnonzero(np.array(lengths) == dims)
            x = whole(flat, starts, rows, dims)
            yield pa.RecordBatch.from_arrays([pa.array(list(dict.fromkeys(r.tobytes() for r in x)), pa.binary())], names=["x"])

    return df.select(named(vector)).mapInArrow(distinct, "x binary").distinct()


def chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.column(0).slice(at, CHUNK).to_pylist()
            yield np.frombuffer(b"".join(part), np.int64).reshape(-1, dims)


def centred(x: np.ndarray, model_n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the exact mean: the whole part of the mean goes first, so that only its fraction is rounded."""
    base = np.array([s // model_n for s in sums], np.int64)
    rest = np.array([(s % model_n) / model_n for s in sums])
    return (x - base).astype(np.float64) - rest


def tree(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """What merge makes of all parts (id, values: doubles), FAN at a time; each level is a stored table. None: no parts."""
    ship_package(parts.sparkSession)

    @F.arrow_udf("array<double>")
    def together(groups: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in groups:
            yield pa.array([merge([np.array(v) for v in row.as_py()]) for row in batch], pa.list_(pa.float64()))

    level = stored(parts, "level")
    while (n := level.count()) > 1:
        level = stored(level.groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "values"))), lambda p: p["values"]).alias("parts")).select("id", together("parts").alias("values")), "level")
    row = level.first() if n else None
    return np.array(row["values"]) if row else None


def partials(rows: DataFrame, reduce_: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> DataFrame:
    """One part a partition that has rows: its number and the values that reduce_ makes of its batches."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = reduce_(batches)
        if values is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([values.ravel()], pa.list_(pa.float64()))], names=["id", "values"])

    return rows.mapInArrow(run, "id bigint, values array<double>")


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors of the fit list and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for x in chunks(batches, dims):
            n += len(x)
            high += (x >> LOW).sum(0)
            low += (x & ((1 << LOW) - 1)).sum(0)
        if n:
            totals = [Decimal((int(h) << LOW) + int(v)) for h, v in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int64()), pa.array([Decimal(n), *totals], pa.decimal128(38, 0))], names=["at", "total"])

    found = {r.at: int(r.total) for r in fit.mapInArrow(add, "at bigint, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    return (found.pop(-1), tuple(found[k] for k in range(dims))) if found else (0, ())


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows, square."""
    dims = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == dims else np.vstack([r, np.zeros((dims - len(r), dims))])


def factor(fit: DataFrame, dims: int, n: int, sums: tuple[int, ...]) -> np.ndarray | None:
    """The triangular factor of the whole centred fit list."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        r = None
        for x in chunks(batches, dims):
            y = centred(x, n, sums)
            r = triangle(y if r is None else np.vstack([r, y]))
        return r

    merged = tree(partials(fit, of_partition), lambda parts: triangle(np.vstack([p.reshape(dims, dims) for p in parts])).ravel())
    return None if merged is None else merged.reshape(dims, dims)


def fit(df: DataFrame, vector: str = "embedding", components: int = 4) -> tuple[Model, DataFrame]:
    """Whitening of df's vectors and the fit list it was made from, a stored table.

    Components of no variance, to double precision, are left out: a table of one vector, or an empty one, has none.
    """
    ship_package(df.sparkSession)
    dims = usual_length(df, vector)
    rows = stored(fit_list(df, vector, dims), "fit")
    n, sums = exact_sums(rows, dims) if dims else (0, ())
    r = factor(rows, dims, n, sums) if n else None
    if r is None:
        return Model(dims, n, sums, np.zeros((0, dims)), np.zeros(0), np.zeros(0)), rows
    _, s, vt = np.linalg.svd(r)
    trace = (s * s).sum()
    some = int((s > s[0] * np.finfo(float).eps * max(n, dims)).sum()) if s[0] > 0 else 0
    k = min(components, some)
    return Model(dims, n, sums, vt[:k], s[:k] ** 2 / n, s[:k] ** 2 / trace if trace else np.zeros(0)), rows


def whitened_rows(x: np.ndarray, model: Model) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.components / np.sqrt(model.variances)[:, None]).T


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """How far the whitened fit list's covariance is from the identity at most; None without components.

    Means and products about them are merged pairwise, so nothing is multiplied before it is centred.
    """
    k = len(model.variances)
    if not k:
        return None

    def of_partition(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        parts = []
        for x in chunks(batches, model.dims):
            z = whitened_rows(x, model)
            m = z.mean(0)
            parts.append(np.concatenate([[len(z)], m, ((z - m).T @ (z - m)).ravel()]))
        return together(parts) if parts else None

    def together(parts: list[np.ndarray]) -> np.ndarray:
        p = np.array(parts)
        n, m = p[:, 0], p[:, 1 : k + 1]
        mean = (n[:, None] * m).sum(0) / n.sum()
        apart = m - mean
        return np.concatenate([[n.sum()], mean, p[:, k + 1 :].sum(0) + ((n[:, None] * apart).T @ apart).ravel()])

    total = tree(partials(rows, of_partition), together)
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n * x - S) squared, exact; in plain longs where they surely suffice."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    y = x.astype(object) * n - np.array(sums, object)
    return (y * y).sum(1).tolist()


def whitened(df: DataFrame, model: Model, vector: str = "embedding", column: str = "white") -> DataFrame:
    """df with a struct: deviation, deviation_exact and values (one a component); null where the vector is not usable.

    deviation is a long and null where it does not fit one; deviation_exact, a decimal, is null beyond 38 digits. Not usable
    are null, empty and odd-length vectors and those with null or non-finite entries, or entries too large to be whole
    numbers of 62 bits. Other columns stay, whatever their names; one called as column is replaced.
    """
    ship_package(df.sparkSession)

    @F.arrow_udf("struct<deviation:bigint,deviation_exact:decimal(38,0),values:array<double>>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64())]
        for batch in batches:
            lengths, flat, starts = entries(batch)
            rows = np.flatnonzero(np.array(lengths) == model.dims) if model.dims else np.zeros(0, np.int64)
            x = whole(flat, starts, rows, model.dims)
            size: list = [None] * len(batch)
            values: list = [None] * len(batch)
            for row, d, z in zip(rows, deviations(x, model.n, model.sums), whitened_rows(x, model), strict=True):
                size[row], values[row] = d, z
            missing = np.ones(len(batch), bool)
            missing[rows] = False
            fields = [pa.array([d if d is not None and d < 2**63 else None for d in size], kinds[0]), pa.array([Decimal(d) if d is not None and d < 10**38 else None for d in size], kinds[1]), pa.array(values, kinds[2])]
            yield pa.StructArray.from_arrays(fields, names=["deviation", "deviation_exact", "values"], mask=pa.array(missing))

    return df.withColumn(column, make(named(vector)))


def with_whitening(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """A row for each usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Components go by falling variance, with either sign, the same for all rows; those without variance are left out, so that
    an empty table, or one vector and its copies, give no rows. Vectors of another length than most are not usable (see
    whitened). Null keys and repeated rows each give their rows; other columns, whatever their names, are left out.
    """
    model, rows = fit(df, vector, components)
    error = identity_error(rows, model)
    white = unused(df, "white")
    found = whitened(df.select(named(key).alias("vec_id"), named(vector).alias("v")), model, "v", white).filter(F.col(white).isNotNull())
    shares = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    out = found.select("vec_id", F.posexplode(F.col(white)["values"]).alias("at", "whitened"), F.col(white)["deviation"].alias("deviation"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
