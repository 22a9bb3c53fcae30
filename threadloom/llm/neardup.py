"""Near duplicates by HyperMinHash.

A document's set are its distinct shingles as 64-bit hashes. Each hash goes to a bucket; a bucket keeps of its smallest hash
the number of leading zeros and some bits after the first one (16 bits in all). Registers are banded four to a band, a band
being its 64 bits. Documents that share a band are candidates; the share of equal registers, less the collisions to be
expected, estimates their similarity; what may reach the threshold is confirmed on the full sets.

Equal sets are one representative from the start. In a band's group every member is first compared with the group's
smallest id only, so a group of n gives n pairs. What lies in one component after that needs no comparing. In groups that
still hold several components all pairs between components are then estimated and confirmed in blocks, where only links
are written, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, kept, named, ship_package, stored, stored_counted, unused

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS = 4
BANDS = BUCKETS // ROWS
#: Standard errors by which an estimate may lie below the threshold and still be confirmed.
MARGIN = 5.5
#: Members of a leader that are worked off together with their texts, and of a band's group with registers.
BLOCK = 256
REGISTER_BLOCK = 1024
#: Up to so many ids are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members of a family's block, and bytes of their texts: a task holds two blocks.
FAMILY_BLOCK = 1024
FAMILY_BYTES = 2_000_000
MAX_WORDS = 150_000

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Words(dict):
    """Word (bytes) to its row in an array of 64-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self[word] = n = len(self.hashes) - 1
        return n


class Shingler:
    def __init__(self, width: int):
        self.width = width
        self.reset()

    def reset(self) -> None:
        self.seen = Words()
        self.seen.hashes = []
        self.table = np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text; texts shorter than a shingle are one whole."""
        if len(self.seen) > MAX_WORDS:
            self.reset()
        number = self.seen.__getitem__
        rows = [np.fromiter(map(number, t.lower().split()), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if len(self.seen.hashes) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.seen.hashes[len(self.table) :], np.uint64)])
        for r in rows:
            if not len(r):
                yield np.zeros(0, np.uint64)
                continue
            w = self.table[r]
            k = min(self.width, len(w))
            h = np.full(len(w) - k + 1, k, np.uint64)
            for j in range(k):
                h = (h ^ w[j : len(w) - k + 1 + j]) * MIX[0]
                h ^= h >> np.uint64(29)
            h = (h ^ (h >> np.uint64(30))) * MIX[1]
            h = (h ^ (h >> np.uint64(27))) * MIX[2]
            yield np.unique(h ^ (h >> np.uint64(31)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros plus one and mantissa bits of each bucket's smallest hash; 0 for an empty bucket."""
    rest = np.uint64(64 - BUCKET_BITS)
    edges = np.searchsorted(shingles, np.arange(BUCKETS, dtype=np.uint64) << rest)
    full = np.flatnonzero(edges < np.append(edges[1:], len(shingles)))
    low = shingles[edges[full]] << np.uint64(BUCKET_BITS)
    # the position of the first one, exact for numbers of up to 64 bits: half at a time
    zeros = np.zeros(len(low), np.uint64)
    x = low.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = x < (np.uint64(1) << np.uint64(64 - step))
        x[small] <<= np.uint64(step)
        zeros[small] += np.uint64(step)
    zeros = np.minimum(zeros, np.uint64(62))
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def shingler_of(width: int) -> Shingler:
    return kept(("shingler", width), lambda: Shingler(width))


def parts(batch: pa.RecordBatch, column: int, rows: int = 128) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).cast(pa.binary()).to_pylist()


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(a), int(b)


def signatures(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """doc_id, n_shingles, set key (k1, k2) and bands of every row; documents without words have no key and no bands."""
    ship_package(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingler_of(width)
        for batch in batches:
            sizes, keys, flat = [], [], []
            for _, texts in parts(batch, 1):
                for s in shingler.sets(texts):
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else (None, None))
                    if len(s):
                        flat.append(registers(s).view("<i8"))
            full = np.array(sizes) > 0
            ends = np.concatenate([[0], np.cumsum(full) * BANDS]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array([k[c] for k in keys], pa.int64()) for c in (0, 1)), bands], schema=schema)

    return df.select(named(key).cast("long").alias("doc_id"), named(text).alias("text")).mapInArrow(sign, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of register rows, and its standard error at the given similarity's worst, a half.

    Registers that are empty on both sides tell nothing. Equal registers of different hashes are expected as in the
    HyperMinHash paper's approximation for two sets of sizes na and nb.
    """
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    high, low = np.maximum(na, nb).astype(float), np.minimum(na, nb).astype(float)
    ratio = high / np.maximum(low, 1)
    by_chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    used = np.maximum(used, 1)
    return np.maximum(same - by_chance, 0) / used, used


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may have 100 * intersection >= percent * union, by their sizes and by the estimate less its error."""
    j = percent / 100
    estimate, used = estimates(a, b, na, nb)
    error = np.sqrt(j * (1 - j) / used)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (estimate >= j - MARGIN * error - 1 / used)


def as_registers(bands: pa.Array) -> np.ndarray:
    if isinstance(bands, pa.ChunkedArray):
        bands = bands.combine_chunks()
    return np.ascontiguousarray(bands.flatten().to_numpy(zero_copy_only=False)).view("<u2").reshape(len(bands), BUCKETS)


def shared_bands(reps: DataFrame) -> DataFrame:
    """Bands that more than one representative has: band, key, id and leader, the smallest id of the group."""
    bands = reps.select("id", F.posexplode("bands").alias("band", "key")).filter(F.col("key") != 0)
    groups = bands.groupBy("band", "key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter(F.col("n") > 1)
    return bands.join(groups, ["band", "key"]).select("band", "key", "id", "leader")


def by_ids(rows: DataFrame, ids: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with a stored table of ids: broadcast if there are few, so that texts stay where they are."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that may reach the threshold, with their estimate."""
    a = reps.select("id", F.col("n_shingles").alias("n_id"), F.col("bands").alias("bands_id"))
    b = reps.select(F.col("id").alias("leader"), F.col("n_shingles").alias("n_leader"), F.col("bands").alias("bands_leader"))
    # sizes alone rule most out before registers travel
    pairs = pairs.join(reps.select("id", F.col("n_shingles").alias("n_id")), "id").join(reps.select(F.col("id").alias("leader"), F.col("n_shingles").alias("n_leader")), "leader")
    pairs = pairs.filter(100 * F.least("n_id", "n_leader") >= percent * F.greatest("n_id", "n_leader")).select("id", "leader")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = as_registers(batch.column(4)), as_registers(batch.column(5))
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = may_reach(x, y, na, nb, percent)
            estimate, _ = estimates(x, y, na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good)), pa.array(estimate[good])], names=["id", "leader", "estimate"])

    rows = pairs.join(a, "id").join(b, "leader").select("id", "leader", "n_id", "n_leader", "bands_id", "bands_leader")
    return rows.mapInArrow(compare, "id bigint, leader bigint, estimate double")


def texts_of(df: DataFrame, ids: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """Texts of ids (id, k1): of rows that share an id, those with the set in question."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingler_of(width)
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            keep = [set_key(s)[0] for _, texts in parts(batch, 1) for s in shingler.sets(texts)]
            yield batch.select([0, 1]).filter(pa.array([a == b for a, b in zip(keep, wanted, strict=True)], pa.bool_()))

    rows = df.select(named(key).cast("long").alias("id"), named(text).alias("text"))
    rows = by_ids(rows, ids, "id").select("id", "text", "k1")
    return rows.mapInArrow(own, "id bigint, text string")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (id, leader) whose full sets reach the threshold.

    A leader's text goes once to every block of its members' texts; a task reads them one after the other.
    """
    pairs = with_blocks(pairs, ["leader"], BLOCK).select("id", "leader", "block")
    member = pairs.join(texts, "id").select("leader", "block", F.lit(1).alias("role"), "id", "text")
    leader = pairs.select("leader", "block").distinct().join(texts.withColumnRenamed("id", "leader"), "leader").select("leader", "block", F.lit(0).alias("role"), F.col("leader").alias("id"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingler_of(width)
        own = np.zeros(0, np.uint64)
        for batch in batches:
            ids, found = [], []
            for part, texts in parts(batch, 4):
                for lead, role, i, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), shingler.sets(texts), strict=True):
                    if role == 0:
                        own = s
                        continue
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    both = int((own[at] == s).sum())
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        ids.append(i)
                        found.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["id", "leader"])

    rows = member.unionByName(leader).repartition("leader", "block").sortWithinPartitions("leader", "block", "role", "id")
    return rows.mapInArrow(check, "id bigint, leader bigint")


def with_blocks(rows: DataFrame, group: list[str], size: int, text: str | None = None) -> DataFrame:
    """rows with blocks, the number of blocks of about size that their group makes, and block, by a hash of id.

    With text, a block's texts are of about FAMILY_BYTES too. Only groups of several blocks are kept with their number, so
    these are few; they are broadcast up to BROADCAST_IDS.
    """
    blocks = F.ceil(F.count("*") / F.lit(size))
    if text:
        blocks = F.greatest(blocks, F.ceil(F.sum(F.octet_length(text)) / F.lit(FAMILY_BYTES)))
    large = stored(rows.groupBy(*group).agg(blocks.cast("int").alias("blocks")).filter("blocks > 1"), "large")
    return by_ids(rows, large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of edges (id, leader).

    Each round points every node at its smallest neighbour, follows the pointers to their roots, and replaces nodes by
    roots; at least half of the nodes that still have an edge go. Every round is a stored table.
    """
    edges, left = stored_counted(edges.select(F.greatest("id", "leader").alias("u"), F.least("id", "leader").alias("v")).filter("u <> v").distinct())
    roots = None
    while left:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "up")
        moved = 1
        while moved:
            # two steps up at once, so that paths are a quarter as long each time
            on = up.select(F.col("u").alias("p"), F.col("p").alias("p2"))
            far = on.join(on.select(F.col("p").alias("p2"), F.col("p2").alias("p3")), "p2").select("p", "p3")
            up, moved = stored_counted(up.join(far, "p").select("u", F.col("p3").alias("p"), (F.col("p") != F.col("p3")).alias("moved")), "moved")
            up = up.select("u", "p")
        if roots is None:
            roots = up.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            roots = stored(roots.join(up.select(F.col("u").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "roots")
        a, b = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges, left = stored_counted(edges.join(a, "u").join(b, "v").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).filter("u <> v").distinct())
    return roots if roots is not None else edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def forest(n: int, found: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Of edges (k, others) over n nodes a few that connect the same: n - 1 at most."""
    label = np.arange(n)
    out = []
    for k, others in found:
        if not len(others):
            continue
        labels, at = np.unique(label[others], return_index=True)
        new = labels != label[k]
        if new.any():
            out += [(k, int(j)) for j in others[at[new]]]
            label[np.isin(label, labels)] = label[k]
    return out


def in_blocks(rows: DataFrame, group: list[str], payload: list[str], size: int, text: str | None = None) -> DataFrame:
    """Rows of a group in blocks of about size, see with_blocks, every two blocks of a group in one row: rows, right (null: with itself).

    Pairs of blocks that hold a single component are left out.
    """
    # dealt anew: a group's blocks would else stay in the one task that an earlier join brought the group to
    blocks = with_blocks(rows, group, size, text).repartition(*group, "block")
    blocks = blocks.groupBy(*group, "blocks", "block").agg(F.collect_list(F.struct(*payload)).alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = blocks.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = blocks.select(*group, F.col("block").alias("other"), F.col("rows").alias("right"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    met = left.join(right, [*group, "other"]).filter("lo <> hi OR rlo <> rhi OR lo <> rlo")
    return met.select("rows", F.when(F.col("block") != F.col("other"), F.col("right")).alias("right"))


def fields(batch: pa.RecordBatch, at: int, names: list[str]) -> tuple[int, dict[str, pa.Array]]:
    """The rows of both blocks end to end, and how many are the first's (0: a block with itself)."""
    one, two = batch.column(0)[at].values, batch.column(1)[at]
    parts = [one, two.values] if two.is_valid else [one]
    return (len(one) if two.is_valid else 0), {n: pa.concat_arrays([x.field(n) for x in parts]) for n in names}


def edges_batch(ids: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u = np.array([ids[k] for k, _ in edges], np.int64)
    v = np.array([ids[j] for _, j in edges], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["id", "leader"])


def candidates(first: int, component: np.ndarray, sizes: np.ndarray, registers_of: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows (of the other block, if there is one) of another component that may be similar."""
    n = len(component)
    for k in range(first or n):
        other = np.arange(max(first, k + 1), n)
        other = other[component[other] != component[k]]
        if len(other):
            yield k, other[may_reach(registers_of[other], registers_of[k][None, :], sizes[other], np.full(len(other), sizes[k]), percent)]


def mixed_rows(reps: DataFrame, shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (band, key, id, component, n_shingles, bands) of band groups that hold several components.

    Groups of two have been compared through their leader.
    """
    bands = shared.select("band", "key", "id").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = bands.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi AND n > 2").select("band", "key")
    return bands.join(mixed, ["band", "key"]).join(reps.select("id", "n_shingles", "bands"), "id")


def families(reps: DataFrame, shared: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Representatives that share a band with one of another component that may be similar: id, family, component.

    A family is closed: who may be similar to a member is in it. Only groups of bands that hold several components are
    looked at, by registers, and each pair of blocks gives at most as many edges as it has rows.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                first, x = fields(batch, at, ["id", "component", "n_shingles", "bands"])
                ids = x["id"].to_numpy()
                yield edges_batch(ids, forest(len(ids), candidates(first, x["component"].to_numpy(), x["n_shingles"].to_numpy(), as_registers(x["bands"]), percent)))

    rows = mixed_rows(reps, shared, comps)
    edges = in_blocks(rows, ["band", "key"], ["id", "component", "n_shingles", "bands"], REGISTER_BLOCK).mapInArrow(meet, "id bigint, leader bigint").distinct()
    found = components(edges).withColumnRenamed("component", "family").join(comps, "id", "left")
    return found.withColumn("component", F.coalesce("component", "id"))


def within(members: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Confirmed links between components of each family (id, family, component), as many as connect them.

    Every two blocks of a family meet once with their texts; all pairs that may be similar are compared on full sets there.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = shingler_of(width)
        for batch in batches:
            for at in range(len(batch)):
                first, x = fields(batch, at, ["id", "component", "text"])
                sets = list(shingler.sets(x["text"].cast(pa.binary()).to_pylist()))
                sizes = np.array([len(s) for s in sets], np.int64)

                def similar(first=first, x=x, sets=sets, sizes=sizes) -> Iterator[tuple[int, np.ndarray]]:
                    for k, others in candidates(first, x["component"].to_numpy(), sizes, np.array([registers(s) for s in sets]), percent):
                        own, good = sets[k], []
                        for j in others:
                            s = sets[j]
                            both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                            if 100 * both >= percent * (len(own) + len(s) - both):
                                good.append(j)
                        yield k, np.array(good, np.int64)

                yield edges_batch(x["id"].to_numpy(), forest(len(sets), similar()))

    rows = stored(members.join(texts, "id"), "members")
    return in_blocks(rows, ["family"], ["id", "component", "text"], FAMILY_BLOCK, "text").mapInArrow(meet, "id bigint, leader bigint").distinct()


def clusters(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """near_duplicates() with the set keys k1 and k2 of each row."""
    signed = stored(signatures(df, text, key, width), "signatures")
    reps = signed.filter(F.col("k1").isNotNull() & F.col("doc_id").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    reps = stored(reps, "representatives")
    shared = stored(shared_bands(reps), "shared")
    pairs = stored(estimated(shared.filter("id <> leader").select("id", "leader").distinct(), reps, percent), "pairs")
    # the likeliest leader of each first; then what is still apart
    first = stored(pairs.groupBy("id").agg(F.max_by("leader", F.struct("estimate", -F.col("leader"))).alias("leader")))
    ends = stored(pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct().join(reps.select("id", "k1"), "id"))
    texts = stored(texts_of(df, ends, text, key, width), "texts")
    links = stored(confirmed(first, texts, percent, width))
    comps = components(links)
    named_ = comps.select("id", F.col("component").alias("ci"))
    apart = pairs.select("id", "leader").join(first, ["id", "leader"], "left_anti").join(named_, "id", "left").join(comps.select(F.col("id").alias("leader"), F.col("component").alias("cl")), "leader", "left")
    apart, n = stored_counted(apart.filter(F.coalesce("ci", "id") != F.coalesce("cl", "leader")).select("id", "leader"))
    if n:
        links = stored(links.unionByName(confirmed(apart, texts, percent, width)))
        comps = components(links)
    rest, n = stored_counted(families(reps, shared, comps, percent), name="families")
    if n:
        ids = stored(rest.select("id").join(reps.select("id", "k1"), "id"))
        links = links.unionByName(within(rest, texts_of(df, ids, text, key, width), percent, width))
        comps = components(links)
    # one id may name several sets, so components meet there too
    of_set = reps.join(comps, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("c"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "k1", "k2")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 * intersection >= percent * union of their sets of width-word shingles (A-Z lower-cased;
    with fewer words, the whole sequence). component_id is the smallest id reachable over links. Documents without words are
    linked with nothing. Rows with a null id keep a null component_id and kept true and link nothing; rows that share an id
    are separate documents with one name. Repeated rows each give a row. Extra columns are left out; an empty table gives none.
    """
    return clusters(df, text, key, width, percent).drop("k1", "k2")


def with_set_keys(df: DataFrame, text: str, width: int, names: tuple[str, str]) -> DataFrame:
    """df with the set key of each row's text in two columns; 0 and 0 for texts without words."""
    ship_package(df.sparkSession)

    @F.arrow_udf("struct<k1:bigint,k2:bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = shingler_of(width)
        for batch in batches:
            found = np.array([set_key(s) if len(s) else (0, 0) for x in batch.cast(pa.binary()) for s in shingler.sets([x.as_py()])], np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["k1", "k2"])

    both = unused(df, "set_key")
    return df.withColumn(both, keys(named(text))).withColumns({names[0]: F.col(both)["k1"], names[1]: F.col(both)["k2"]}).drop(both)


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of df for each component: the one with the smallest id.

    Of rows that share that id and the set of shingles one stays, the first by text and the rest of the row; rows that share
    an id with other sets are documents of their own. Rows without words stay, one for each id; rows with a null id all stay.
    Columns and texts are unchanged, whatever their names.
    """
    near = stored(clusters(df, text, key, width, percent).filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("i"), "kept", F.coalesce("k1", F.lit(0)).alias("a"), F.coalesce("k2", F.lit(0)).alias("b")))
    per_id = near.groupBy("i").agg(F.count("*").alias("n"), F.bool_or("kept").alias("any"))
    i, a, b, line = (unused(df, x) for x in ("i", "a", "b", "line"))
    gone = stored(per_id.filter("n = 1 AND NOT any").select(F.col("i").alias(i)), "dropped")
    shared, n = stored_counted(per_id.filter("n > 1").select(F.col("i").alias(i)))
    rows = by_ids(df.withColumn(i, named(key).cast("long")), gone, i, "left_anti")
    if not n:
        return rows.select(*columns_of(df))
    # ids of several rows: each row by its own set
    single = by_ids(rows, shared, i, "left_anti").select(*columns_of(df))
    several = with_set_keys(by_ids(rows, shared, i, "left_semi"), text, width, (a, b))
    staying = near.filter("kept").select(F.col("i").alias(i), F.col("a").alias(a), F.col("b").alias(b)).distinct().join(shared, i, "left_semi")
    several = several.join(staying, [i, a, b], "left_semi")
    order = F.struct(F.coalesce(named(text), F.lit("")), F.to_json(F.struct(*(named(c) for c in df.columns)), {"ignoreNullFields": "false"}))
    one = several.groupBy(i, a, b).agg(F.min_by(F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(df.columns))), order).alias(line))
    return single.unionByName(one.select(*(F.col(line)[f"c{k}"].alias(c) for k, c in enumerate(df.columns))))
