"""Near duplicates of vectors by cross-polytope hashing.

Equal vectors of a label are one node. A node is rotated pseudo-randomly (three times signs, then a fast Hadamard transform)
and hashed to the nearest corner of a cross-polytope; POLYTOPES corners make a code, and each of TABLES tables holds a node
under its own code and the PROBES next likely ones. At a cosine of 0.93 a pair shares a bucket of a table with a chance of
0.64, so it misses all tables with one of 3e-4, and rarer the nearer it is.

Buckets hold node numbers and sketches (the sides of 128 random planes), never vectors. The members of a bucket are compared with
its smallest one by their sketches; what lies in one component then needs no comparing, and buckets that still hold several
are compared in blocks. That gives families: whoever may be linked to a member is in its family. Inside a family every two
blocks of vectors meet once, in the block or by centre and radius alone where these prove that all or no pairs are linked;
only numbers of links and a spanning forest are written, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neardup import components, edges_batch, fields, forest, with_blocks
from .shared import named, ship_package, stored, stored_counted

TABLES = 8
POLYTOPES = 2
PROBES = 2
#: Corners of each polytope that codes are made of, the nearest first.
CORNERS = 3
SKETCH_BITS = 128
LEAST_SIZE = 64
#: Standard deviations by which a sketch of a pair at the threshold may differ more than expected.
MARGIN = 5.5
#: Members of a block of sketches, and of vectors.
SKETCH_BLOCK = 2048
VECTOR_BLOCK = 512
#: Radians by which bounds on angles are taken wider.
SLACK = 1e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows, of a length that is a power of two, times the Hadamard matrix, unscaled."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-random rotation of that number: signs and a transform, three times; scaled as x."""
    signs = np.random.default_rng([20, number]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
        x = x / math.sqrt(x.shape[1])
    return x


def padded(x: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a power of two, LEAST_SIZE at least: short rows would be rotated to few different places."""
    size = max(LEAST_SIZE, 1 << (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def codes(x: np.ndarray, tables: int = TABLES, polytopes: int = POLYTOPES, probes: int = PROBES) -> np.ndarray:
    """For rows of unit length the codes of each table, the nearest first: rows x tables x (1 + probes)."""
    x = padded(x)
    most = CORNERS
    out = []
    for t in range(tables):
        corner, cost = [], []
        for p in range(polytopes):
            y = rotated(x, t * polytopes + p)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :most]
            value = np.take_along_axis(size, best, 1)
            corner.append(2 * best + (np.take_along_axis(y, best, 1) < 0))
            cost.append((value[:, :1] - value) ** 2)
        choices = list(product(range(most), repeat=polytopes))
        total = np.stack([sum(cost[p][:, c[p]] for p in range(polytopes)) for c in choices], 1)
        code = np.stack([sum(corner[p][:, c[p]].astype(np.int64) * (2 * x.shape[1]) ** p for p in range(polytopes)) for c in choices], 1)
        near = np.argsort(total, axis=1, kind="stable")[:, : 1 + probes]
        found = np.take_along_axis(code, near, 1)
        # few corners may make fewer codes than are asked for
        out.append(np.pad(found, ((0, 0), (0, 1 + probes - found.shape[1])), mode="edge"))
    return np.stack(out, 1)


def sketches(x: np.ndarray) -> np.ndarray:
    """The sides of random planes that rows lie on, as two longs a row; planes are independent, which rotations' axes aren't."""
    planes = np.random.default_rng([21, x.shape[1]]).normal(size=(x.shape[1], SKETCH_BITS))
    return np.packbits(x @ planes > 0, axis=1).view(">i8").astype(np.int64)


def sketch_limit(least: float) -> int:
    """Most bits that the sketches of a pair of that cosine differ in."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(SKETCH_BITS * p + MARGIN * math.sqrt(SKETCH_BITS * p * (1 - p)))


def differing(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def doubles(vectors: pa.Array) -> Iterator[np.ndarray | None]:
    """Each vector as doubles; None: null, empty, zero, or with null or non-finite entries."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for ok, a, b in zip(vectors.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True):
        v = flat[a:b]
        yield v + 0.0 if ok and b > a and np.isfinite(v).all() and v.any() else None


def units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; a power of two is taken out first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def own_type(df: DataFrame, vector: str) -> str:
    """The numpy type that holds the vectors' entries exactly."""
    return "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def keyed(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, grp, k1, k2 and v (entries of own_type as bytes) of every row; what links with nothing has no grp.

    grp is the label and the length; k1 and k2 are a 128-bit hash of the vector.
    """
    kind = own_type(df, vector)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grp, bodies = [], [], []
            for x, of in zip(doubles(batch.column(2)), batch.column(1).to_pylist(), strict=True):
                good = x is not None and of is not None
                bodies.append(x.astype(kind).tobytes() if good else None)
                grp.append(f"{len(x)}:{of}" if good else None)
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(bodies[-1]), "<i8") if good else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grp, pa.string()), *(pa.array([k[c] for k in keys], pa.int64()) for c in (0, 1)), pa.array(bodies, pa.binary())], names=["id", "grp", "k1", "k2", "v"])

    rows = df.select(named(key).cast("long").alias("id"), named(label).cast("string").alias("label"), named(vector).alias("v"))
    return rows.mapInArrow(read, "id bigint, grp string, k1 bigint, k2 bigint, v binary")


def nodes_of(rows: DataFrame, kind: str, tables: int, polytopes: int, probes: int) -> DataFrame:
    """Distinct vectors of a label: node (its number), rep (smallest id), copies, grp, keys, v, sketch and buckets. Stored."""
    kinds = rows.filter("grp IS NOT NULL AND id IS NOT NULL").groupBy("grp", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(5).to_pylist()
            lengths = np.array([len(b) for b in v])
            buckets = np.zeros((len(v), tables * (1 + probes)), np.int64)
            signs = np.zeros((len(v), 2), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = units(np.frombuffer(b"".join(v[k] for k in at), kind).astype(np.float64).reshape(len(at), -1))
                buckets[at] = codes(x, tables, polytopes, probes).reshape(len(at), -1)
                signs[at] = sketches(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * buckets.shape[1], pa.int32()), pa.array(buckets.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs[:, 0]), pa.array(signs[:, 1]), lists], names=[*batch.schema.names, "s1", "s2", "codes"])

    made = kinds.select("grp", "k1", "k2", "rep", "copies", "v").mapInArrow(hash_, "grp string, k1 bigint, k2 bigint, rep bigint, copies bigint, v binary, s1 bigint, s2 bigint, codes array<bigint>")
    return stored(made.withColumn("node", F.monotonically_increasing_id()), "nodes")


def bucketed(nodes: DataFrame, probes: int) -> DataFrame:
    """Members of buckets that hold two nodes or more: bucket, node, sketch, and leader, the smallest node, with its sketch."""
    rows = nodes.select("node", "s1", "s2", "grp", F.posexplode("codes").alias("at", "code"))
    # a probe may repeat a code of its table
    rows = rows.select(F.xxhash64("grp", F.floor(F.col("at") / (1 + probes)), "code").alias("bucket"), "node", "s1", "s2").distinct()
    groups = rows.groupBy("bucket").agg(F.min(F.struct("node", "s1", "s2")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(groups, "bucket")


def sketch_links(shared: DataFrame, comps: DataFrame | None, limit: int) -> DataFrame:
    """Edges (id, leader) between nodes that share a bucket and whose sketches differ in limit bits at most.

    Without comps those to the leader; with comps, in buckets that still hold several components, a forest over all pairs.
    """
    if comps is None:
        near = differing((F.col("s1"), F.col("s2")), (F.col("leader.s1"), F.col("leader.s2"))) <= limit
        return shared.filter(near & (F.col("node") != F.col("leader.node"))).select(F.col("node").alias("id"), F.col("leader.node").alias("leader")).distinct()
    rows = shared.filter("n > 2").select("bucket", F.col("node").alias("id"), "s1", "s2").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    rows = stored(rows.join(mixed, "bucket"), "mixed")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                first, x = fields(batch, at, ["id", "component", "s1", "s2"])
                of, one, two = (x[c].to_numpy().astype(np.int64) for c in ("component", "s1", "s2"))

                found = list(near_rows(first, of, one.view(np.uint64), two.view(np.uint64), limit))
                if found:
                    yield edges_batch(x["id"].to_numpy(), forest(len(of), iter(found)))

    return block_pairs(rows, ["bucket"], ["id", "component", "s1", "s2"], SKETCH_BLOCK).mapInArrow(meet, "id bigint, leader bigint").distinct()


def near_rows(first: int, of: np.ndarray, one: np.ndarray, two: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block that have sketches near theirs among the later rows (of the other block, if first isn't 0) of other components."""
    ends = first or len(of)
    for at in range(0, ends, 128):
        k = np.arange(at, min(at + 128, ends))
        apart = np.bitwise_count(one[k, None] ^ one[None, first:]).astype(np.int16) + np.bitwise_count(two[k, None] ^ two[None, first:])
        rows, others = np.nonzero((apart <= limit) & (of[k, None] != of[None, first:]))
        rows, others = rows + at, others + first
        later = others > rows
        rows, others = rows[later], others[later]
        for r in np.unique(rows):
            yield int(r), others[rows == r]


def block_pairs(rows: DataFrame, group: list[str], payload: list[str], size: int) -> DataFrame:
    """Every two blocks of a group that hold more than one component between them, in one row: rows, right (null: itself)."""
    blocks = with_blocks(rows, group, size).repartition(*group, "block")
    blocks = blocks.groupBy(*group, "blocks", "block").agg(F.collect_list(F.struct(*payload)).alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = blocks.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = blocks.select(*group, F.col("block").alias("other"), F.col("rows").alias("right"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    met = left.join(right, [*group, "other"]).filter("lo <> hi OR rlo <> rhi OR lo <> rlo")
    return met.select("rows", F.when(F.col("block") != F.col("other"), F.col("right")).alias("right"))


def vector_blocks(members: DataFrame, kind: str) -> DataFrame:
    """Members (family, grp, id, copies, v) in blocks with their centre, radius (the widest angle to it), weight and lead. Stored."""

    @F.arrow_udf("struct<centre:array<double>,radius:double>")
    def ball(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            centres, radii = [], []
            for row in batch:
                x = units(np.frombuffer(b"".join(row.values.to_pylist()), kind).astype(np.float64).reshape(len(row.values), -1))
                c = x.mean(0)
                size = math.sqrt(float(c @ c))
                c = c / size if size > 1e-9 else x[0]
                centres.append(c)
                radii.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            yield pa.StructArray.from_arrays([pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=["centre", "radius"])

    rows = with_blocks(members, ["family", "grp"], VECTOR_BLOCK).repartition("family", "grp", "block")
    rows = rows.groupBy("family", "grp", "blocks", "block").agg(F.collect_list(F.struct("id", "copies", "v")).alias("rows"), F.sum("copies").alias("weight"), F.min("id").alias("lead"))
    return stored(rows.withColumn("ball", ball(F.col("rows")["v"])).select("*", "ball.*").drop("ball"), "blocks")


def judged(blocks: DataFrame, least: float) -> DataFrame:
    """Every two blocks of a family once, a block with itself too: all or none of their pairs are linked, or check."""
    wide = math.acos(least)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("block", "centre", "radius", "weight", "lead")]
    left = blocks.select("family", "grp", *side("a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block_b"))
    met = left.join(blocks.select("family", "grp", *side("b")), ["family", "grp", "block_b"])
    cosine = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = F.when(F.col("block_a") == F.col("block_b"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    reach = F.col("radius_a") + F.col("radius_b")
    verdict = F.when(far + reach <= wide - SLACK, "all").when(far - reach > wide + SLACK, "none").otherwise("check")
    return met.select("family", "grp", "block_a", "block_b", "weight_a", "weight_b", "lead_a", "lead_b", verdict.alias("verdict"))


def linked(members: DataFrame, kind: str, least: float) -> DataFrame:
    """Rows (id, links, leader): vectors linked to a node beside its copies, and links that connect what is linked. Stored."""
    blocks = vector_blocks(members, kind)
    pairs = stored(judged(blocks, least), "judged")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                first, x = fields(batch, at, ["id", "copies", "v"])
                v = units(np.frombuffer(b"".join(x["v"].to_pylist()), kind).astype(np.float64).reshape(len(x["id"]), -1))
                ids, copies = x["id"].to_numpy(), x["copies"].to_numpy()
                on = (v[: first or len(v)] @ v[first:].T) >= least
                if not first:
                    np.fill_diagonal(on, False)
                links = np.zeros(len(v), np.int64)
                links[: first or len(v)] += on @ copies[first:]
                if first:
                    links[first:] += on.T @ copies[:first]
                some = np.flatnonzero(links)
                joined = forest(len(v), ((k, np.flatnonzero(on[k]) + first) for k in range(len(on))))
                a, b = (np.array([ids[e[c]] for e in joined], np.int64) for c in (0, 1))
                n = len(some), len(joined)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], a])), pa.array(np.concatenate([links[some], np.zeros(n[1], np.int64)])), pa.array([None] * n[0] + b.tolist(), pa.int64())], names=["id", "links", "leader"])

    rows = blocks.select("family", "grp", "block", "rows")
    check = pairs.filter("verdict = 'check'").select("family", "grp", "block_a", "block_b")
    check = check.join(rows.withColumnsRenamed({"block": "block_a"}), ["family", "grp", "block_a"])
    check = check.join(rows.select("family", "grp", F.col("block").alias("block_b"), F.col("rows").alias("right")), ["family", "grp", "block_b"])
    check = check.select("rows", F.when(F.col("block_a") != F.col("block_b"), F.col("right")).alias("right"))
    # blocks of which all pairs are linked: weights for all members, and one link a member
    every = pairs.filter("verdict = 'all'")
    more = every.filter("block_a <> block_b").select("family", "grp", F.explode(F.array(F.struct(F.col("block_a").alias("block"), F.col("weight_b").alias("w"), F.col("lead_b").alias("to")), F.struct(F.col("block_b").alias("block"), F.col("weight_a").alias("w"), F.col("lead_a").alias("to")))).alias("s")).select("family", "grp", "s.*")
    own = every.filter("block_a = block_b").select("family", "grp", F.col("block_a").alias("block"), F.col("weight_a").alias("w"), F.col("lead_a").alias("to"))
    sums = more.withColumn("own", F.lit(0)).unionByName(own.withColumn("own", F.lit(1))).groupBy("family", "grp", "block").agg(F.sum("w").alias("w"), F.max("own").alias("own"), F.min("to").alias("to"))
    links_to = every.filter("block_a <> block_b").select(F.col("lead_a").alias("id"), F.lit(0).cast("bigint").alias("links"), F.col("lead_b").alias("leader"))
    whole = blocks.join(sums, ["family", "grp", "block"]).select(F.explode("rows").alias("m"), "w", "own", "to")
    whole = whole.select(F.col("m.id").alias("id"), (F.col("w") - F.when(F.col("own") == 1, F.col("m.copies")).otherwise(0)).alias("links"), F.col("to").alias("leader"))
    found = check.mapInArrow(meet, "id bigint, links bigint, leader bigint").unionByName(whole).unionByName(links_to)
    return stored(found, "links")


def near_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", least: float = 0.93, tables: int = TABLES, polytopes: int = POLYTOPES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two vectors of one label are linked if their cosine in double precision is least or more. n_links counts the other
    vectors linked directly, copies included; component_id is the smallest id reachable over links. Vectors that are null,
    empty, zero or hold null or non-finite entries, those without a label, and those of other lengths link with nothing.
    Rows with a null id keep a null component_id and kept true, and link with nothing; rows that share an id are vectors of
    their own, linked like any. Other columns, whatever their names, are left out; an empty table gives none. For tables of
    over a thousand million vectors three polytopes and seven probes keep buckets small.
    """
    ship_package(df.sparkSession)
    rows = keyed(df, key, vector, label)
    kind = own_type(df, vector)
    nodes = nodes_of(rows, kind, tables, polytopes, probes)
    limit = sketch_limit(least)
    shared = stored(bucketed(nodes, probes), "buckets", compression="zstd")
    edges = stored(sketch_links(shared, None, limit), "near")
    comps = components(edges)
    rest, n = stored_counted(sketch_links(shared, comps, limit), name="rest")
    if n:
        comps = components(edges.unionByName(rest))
    members = comps.withColumnRenamed("component", "family").join(nodes.select(F.col("node").alias("id"), "grp", "copies", "v"), "id")
    links = linked(members, kind, least)
    reached = components(links.filter("leader IS NOT NULL").select("id", "leader"))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    of = nodes.select(F.col("node").alias("id"), "grp", "k1", "k2", "rep", "copies").join(reached, "id", "left").join(counts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(first, "component").select("grp", "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "grp", "k1", "k2").join(of, ["grp", "k1", "k2"], "left")
    known = F.col("id").isNotNull()
    out = out.select(F.col("id").alias("vec_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
