"""Merkle fixity audit of WARC archives.

An archive is files of records one after the other. A file's bytes are cut into ranges by offset; a range's hash is over the
records that begin in it, in order: offset, length, copies, id and SHA-256 each. Above it FAN_OUT neighbouring ranges make a
node, up to the file; files lie in buckets of their name's hash, FAN_OUT of which make a node, up to the root. So no node
has more than FAN_OUT children, whatever the ids, and replicas have trees of one shape whatever they lack. Two replicas are
compared from the root; only nodes that differ are entered, and only records of ranges that differ are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import named, stored

FAN_OUT = 256
#: Levels of nodes over ranges up to a file, and over buckets of files up to the root.
RANGE_LEVELS = 3
BUCKET_LEVELS = 3
#: Bytes of a range: the records that begin in it are hashed, and compared, together.
RANGE_BYTES = 1 << 20
#: Records with ids of one such range lie in one archive file.
FILE_IDS = 4096

NODE = ("place", "step", "node")
PLACE = ("id", "warc_file", "record_offset", "record_length", "copies", "record_sha256")


def record_head(page_id: Column, url: Column, payload: Column) -> Column:
    """Header lines of a response record. Null url: an empty field."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One row for each distinct record: id, record_sha256, record_length, copies.

    Repeated rows make one leaf with their number in copies. Null payloads are empty records; null ids are an id of their
    own. Extra columns are left out; an empty table gives none.
    """
    body = F.coalesce(named(payload), F.lit(""))
    record = F.concat(record_head(named(key), named(url), body), body, F.lit("\r\n\r\n"))
    rows = pages.select(named(key).cast("long").alias("id"), F.sha2(record, 256).alias("record_sha256"), F.octet_length(record).cast("long").alias("record_length"))
    return rows.groupBy("id", "record_sha256", "record_length").agg(F.count("*").alias("copies"))


def id_text() -> Column:
    """The id as text; a null id equals no other."""
    return F.coalesce(F.col("id").cast("string"), F.lit("null"))


def placed(records: DataFrame) -> DataFrame:
    """records with warc_file and record_offset, as an archive that is written in order of id and hash has them.

    A file holds FILE_IDS consecutive ids; records without an id are dealt over files null-000 to null-fff by their hash.
    Offsets are running totals in two steps, by id and first byte of the hash and then within, so an id with very many
    records is summed in 256 parts.
    """
    without = F.concat(F.lit("null-"), F.substring("record_sha256", 1, 3))
    rows = records.withColumn("warc_file", F.when(F.col("id").isNull(), without).otherwise(F.floor(F.col("id") / F.lit(FILE_IDS)).cast("string")))
    rows = rows.withColumn("part", F.substring("record_sha256", 1, 2)).withColumn("at", id_text())
    size = F.col("copies") * F.col("record_length")
    earlier = Window.partitionBy("warc_file").orderBy(F.col("id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("warc_file", "id", "at", "part").agg(F.sum(size).alias("bytes"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).select("warc_file", "at", "part", "before")
    within = Window.partitionBy("warc_file", "at", "part").orderBy("record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["warc_file", "at", "part"])
    return rows.withColumn("record_offset", F.col("before") + F.coalesce(F.sum(size).over(within), F.lit(0))).select(*PLACE)


def digest(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def in_range() -> Column:
    return F.floor(F.col("record_offset") / F.lit(RANGE_BYTES)).cast("long")


def above(place: Column, step: int, node: Column) -> tuple[Column, Column]:
    """place and node of the node over one of step: over a file's ranges by number, over files by buckets of their name."""
    up = F.floor(node / F.lit(FAN_OUT)).cast("long")
    if step < RANGE_LEVELS:
        return place, up
    if step == RANGE_LEVELS:
        return F.lit(""), F.pmod(F.xxhash64(place), F.lit(FAN_OUT**BUCKET_LEVELS))
    return F.lit(""), up


TOP = RANGE_LEVELS + 1 + BUCKET_LEVELS


def tree(records: DataFrame) -> DataFrame:
    """Nodes of all levels from placed records: place (a file's name, or ''), step, node, hash, records, bytes.

    Step 0 has a node for each range of a file that records begin in; the one node of step TOP is the root, also of an
    archive without records. All bytes of a record count to the range it begins in. Null ids
    are written as null, and records that repeat count by their copies.
    """
    line = F.concat_ws(":", "record_offset", "record_length", "copies", id_text(), "record_sha256", F.lit(";"))
    rows = records.groupBy(F.col("warc_file").alias("place"), in_range().alias("node"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("record_offset"), line.alias("line")))), lambda x: x["line"])
    levels = [stored(rows.agg(digest(ordered).alias("hash"), F.sum("copies").alias("records"), F.sum(F.col("copies") * F.col("record_length")).alias("bytes")), "ranges")]
    for step in range(TOP):
        place, node = above(F.col("place"), step, F.col("node"))
        rows = levels[-1].select(place.alias("over"), node.alias("up"), "place", "node", "hash", "records", "bytes").groupBy(F.col("over").alias("place"), F.col("up").alias("node"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "node", "hash"))), lambda x: F.concat_ws(":", x["place"], x["node"].cast("string"), x["hash"], F.lit(";")))
        levels.append(stored(rows.agg(digest(children).alias("hash"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")), "nodes"))
    root = levels[-1].agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("hash"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    levels[-1] = root.select(F.lit("").alias("place"), F.lit(0).cast("long").alias("node"), "hash", "records", "bytes")
    out = None
    for step, x in enumerate(levels):
        level = x.select("place", F.lit(step).alias("step"), "node", "hash", "records", "bytes")
        out = level if out is None else out.unionByName(level)
    return out


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes that differ between two trees: place, step, node, left_hash, right_hash; only below nodes that differ.

    Equal trees, those of two empty archives among them, give no rows; a hash is null on the side that lacks the node.
    """

    def side(t: DataFrame, step: int, name: str) -> DataFrame:
        return t.filter(F.col("step") == step).select("place", "node", F.col("hash").alias(name))

    found = None
    wrong: DataFrame | None = None
    for step in range(TOP, -1, -1):
        a, b = side(left, step, "left_hash"), side(right, step, "right_hash")
        if wrong is not None:
            over, up = above(F.col("place"), step, F.col("node"))
            a, b = (x.withColumn("over", over).withColumn("up", up).join(wrong, ["over", "up"], "left_semi").drop("over", "up") for x in (a, b))
        level = stored(a.join(b, ["place", "node"], "full_outer").filter(~F.col("left_hash").eqNullSafe(F.col("right_hash"))).select("place", F.lit(step).alias("step"), "node", "left_hash", "right_hash"), "wrong")
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
        wrong = level.select(F.col("place").alias("over"), F.col("node").alias("up"))
    return found


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every record of the left archive, and those whose id only the right one has, with a status.

    left, right: placed records (id, warc_file, record_offset, record_length, copies, record_sha256). Status: ok; moved (the
    same bytes and copies stand elsewhere on the right); altered (the right has the id, but not this record in as many
    copies); missing (the right lacks the id); extra (the left lacks the id). Records with a null id count as one id. Each
    record is taken by itself, also where an id has many. Empty archives are equal and give no rows.
    """
    left, right = stored(left.select(*PLACE), "left"), stored(right.select(*PLACE), "right")
    ranges = stored(mismatches(tree(left), tree(right)).filter("step = 0").select(F.col("place").alias("warc_file"), F.col("node").alias("range")), "mismatches")
    a, b = (x.withColumn("range", in_range()).withColumn("at", id_text()) for x in (left, right))
    near_a, near_b = (x.join(ranges, ["warc_file", "range"], "left_semi").drop("range") for x in (a, b))
    sound = a.join(ranges, ["warc_file", "range"], "left_anti").select(*PLACE, F.lit("ok").alias("status"))
    there = near_b.select("at", "record_sha256", "copies", F.struct("warc_file", "record_offset").alias("there"))
    met = stored(near_a.join(there, ["at", "record_sha256", "copies"], "left"), "met")
    same = F.when(F.struct("warc_file", "record_offset") == F.col("there"), "ok").otherwise("moved")
    lost = met.filter("there IS NULL")
    known = b.join(lost.select("at").distinct(), "at", "left_semi").select("at", F.lit(True).alias("known")).distinct()
    lost = lost.join(known, "at", "left").withColumn("status", F.when(F.col("known"), "altered").otherwise("missing"))
    extra = near_b.join(a.select("at"), "at", "left_anti").withColumn("status", F.lit("extra"))
    out = sound
    for x in (met.filter("there IS NOT NULL").withColumn("status", same), lost, extra):
        out = out.unionByName(x.select(*PLACE, "status"))
    return out
