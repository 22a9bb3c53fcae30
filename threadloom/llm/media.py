"""Media columns: ISO base media files in binary columns, and what their boxes say.

with_media() stores bytes as the samples of an uncompressed 8-bit grey video track. probe() walks the boxes of any such file
and decodes its sample tables into codec, duration and keyframe byte ranges; it never decodes a payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import named, ship_package

WIDTH = HEIGHT = 24
#: One frame of the stored form: 24 x 24 grey samples of 8 bits.
FRAME = WIDTH * HEIGHT
TIMESCALE = 25
KEYFRAME_EVERY = 12
FRAMES_PER_CHUNK = 16
PAD = b"\xff"

#: Boxes that hold boxes. meta and stsd have fields before them and are handled apart.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class Damaged(ValueError):
    """The bytes are no readable ISO media file."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of a frame."""
    return text + PAD * (-len(text) % FRAME if text else FRAME)


MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def written(payload: bytes) -> bytes:
    """A file with payload, a multiple of a frame, as samples in chunks."""
    n = len(payload) // FRAME
    chunks, tail = divmod(n, FRAMES_PER_CHUNK)
    n_chunks = chunks + bool(tail)
    stsc = [(1, FRAMES_PER_CHUNK, 1)] * bool(chunks) + [(chunks + 1, tail, 1)] * bool(tail)
    keys = range(1, n + 1, KEYFRAME_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def moov(first: int) -> bytes:
        offsets = [first + k * FRAMES_PER_CHUNK * FRAME for k in range(n_chunks)]
        wide = first + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{n_chunks}{'Q' if wide else 'I'}", n_chunks, *offsets)),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  isom")
    first = len(head) + len(moov(0)) + 8
    return head + moov(first) + box(b"mdat", payload)


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the body of each box in a range."""
    at = start
    while at < end:
        if end - at < 8:
            raise Damaged(f"{end - at} stray bytes at {at}")
        length, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if length == 1:
            if end - at < 16:
                raise Damaged(f"short box at {at}")
            length, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif length == 0:
            length = end - at
        if length < body - at or at + length > end:
            raise Damaged(f"box at {at} reaches out of its parent")
        yield kind, body, at + length
        at += length


def tree(data: bytes, start: int, end: int, depth: int = 0) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, body start and body end of every box, parents first; boxes nested over 32 deep are refused."""
    if depth > 32:
        raise Damaged("boxes are nested too deeply")
    for kind, a, b in boxes(data, start, end):
        yield (kind,), a, b
        if kind in CONTAINERS:
            for path, c, d in tree(data, a, b, depth + 1):
                yield (kind, *path), c, d


def table(data: bytes, a: int, b: int, skip: int, columns: int, kind: str = ">u4") -> np.ndarray:
    """Rows of a counted table whose count lies at a + skip."""
    n = struct.unpack_from(">I", data, a + skip)[0]
    size = n * columns * np.dtype(kind).itemsize
    if a + skip + 4 + size > b:
        raise Damaged("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, a + skip + 4).astype(np.int64).reshape(n, columns)


def samples(data: bytes, stbl: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offset and size of every sample, and which are sync samples."""
    a, b = stbl[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    if n * max(fixed, 1) > len(data):
        raise Damaged("samples lie beyond the end")
    sizes = np.full(n, fixed, np.int64) if fixed else table(data, a, b, 8, 1)[:, 0]
    chunks = table(data, *stbl[b"co64"], 4, 1, ">u8")[:, 0] if b"co64" in stbl else table(data, *stbl[b"stco"], 4, 1)[:, 0]
    runs = table(data, *stbl[b"stsc"], 4, 3)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if not len(runs) or not len(chunks) or runs[0, 0] != 1:
        raise Damaged("samples without chunks")
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))))
    if each.sum() != n or each.min() < 0:
        raise Damaged(f"chunks hold {each.sum()} samples of {n}")
    before = np.cumsum(sizes) - sizes
    firsts = np.cumsum(each) - each
    filled = each > 0
    offsets = before + np.repeat(chunks[filled] - before[firsts[filled]], each[filled])
    sync = np.ones(n, bool)
    if b"stss" in stbl:
        sync[:] = False
        sync[table(data, *stbl[b"stss"], 4, 1)[:, 0] - 1] = True
    if (offsets + sizes).max() > len(data):
        raise Damaged("samples lie beyond the end")
    return offsets, sizes, sync


def merged(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges with neighbours that touch made one."""
    if not len(offsets):
        return []
    new = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1]))
    return list(zip(offsets[new].tolist(), np.add.reduceat(sizes, new).tolist(), strict=True))


def tracks(data: bytes) -> list[dict]:
    """Facts of every track with sample tables, in order."""
    out: list[dict] = []
    for path, a, b in tree(data, 0, len(data)):
        if path == (b"moov", b"trak"):
            out.append({"stbl": {}})
        elif path[:2] == (b"moov", b"trak"):
            t, version = out[-1], data[a] if b > a else 0
            if path[-1] == b"mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ" if version else ">II", data, a + (20 if version else 12))
            elif path[-1] == b"hdlr":
                t["handler"] = data[a + 8 : a + 12].decode("latin-1")
            elif path[-1] == b"stsd":
                t["codec"] = next((k.decode("latin-1") for k, _, _ in boxes(data, a + 8, b)), None)
            elif path[-2] == b"stbl":
                t["stbl"][path[-1]] = (a, b)
    for t in out:
        stbl = t.pop("stbl")
        if not {b"stsz", b"stsc"} <= stbl.keys() or not stbl.keys() & {b"stco", b"co64"}:
            raise Damaged("a track has no sample table")
        offsets, sizes, sync = samples(data, stbl)
        if b"stts" in stbl:
            times = table(data, *stbl[b"stts"], 4, 2)
            t["duration"] = int((times[:, 0] * times[:, 1]).sum())
        t["samples"] = len(sizes)
        t["ranges"] = merged(offsets, sizes)
        t["keyframes"] = list(zip(offsets[sync].tolist(), sizes[sync].tolist(), strict=True))
    return out


RANGE = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
PROBED = "struct<error:string,tracks:array<struct<handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,ranges:array<struct<offset:bigint,length:bigint>>,keyframes:array<struct<offset:bigint,length:bigint>>>>>"
PROBED_ARROW = pa.struct([("error", pa.string()), ("tracks", pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("ranges", pa.list_(RANGE)), ("keyframes", pa.list_(RANGE))])))])


def read(data: bytes) -> tuple[list[dict], str | None]:
    try:
        return tracks(data), None
    except (ValueError, struct.error, IndexError, KeyError) as e:
        return [], f"{type(e).__name__}: {e}"


def probe(media: Column) -> Column:
    """Struct of error and tracks of each file; null files give null, unreadable ones an error and no tracks."""

    @F.arrow_udf(PROBED)
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                if not x.is_valid:
                    rows.append(None)
                    continue
                found, error = read(x.as_py())
                pairs = [t | {k: [{"offset": o, "length": n} for o, n in t[k]] for k in ("ranges", "keyframes")} for t in found]
                rows.append({"error": error, "tracks": pairs})
            yield pa.array(rows, PROBED_ARROW)

    return walk(media)


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a binary column that stores each text's bytes as a media file.

    Null texts are stored as empty ones, equal texts as equal files. Repeated rows each give a row, an empty table none; a column
    called as media is replaced.
    """

    @F.arrow_udf("binary")
    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([written(padded((x.as_py() or "").encode())) for x in batch], pa.binary())

    ship_package(df.sparkSession)
    return df.withColumn(media, store(named(text)))


DIGEST = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string,codec:string,seconds:double,keyframes:array<struct<offset:bigint,length:bigint>>>"
DIGEST_ARROW = pa.struct([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("codec", pa.string()), ("seconds", pa.float64()), ("keyframes", pa.list_(RANGE)),
])


def digest(media: Column) -> Column:
    """Checksums of a file and of its first track's payload, cut out by its sample table, its codec, duration and keyframes.

    codec, seconds and keyframes (the byte range of each sync sample) are null for unreadable files.
    feature: codec, handler, seconds, samples, number of keyframes, their first and last byte range, and the CRC-32 of all
    ranges as little-endian 64-bit numbers, as JSON; for unreadable files the error. Equal files give equal facts; no rows, none.
    """

    @F.arrow_udf(DIGEST)
    def facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                if not x.is_valid:
                    rows.append(None)
                    continue
                data = x.as_py()
                found, error = read(data)
                payload = b"".join(data[o : o + n] for o, n in found[0]["ranges"]) if found else b""
                feature, codec, seconds, ranges = {"error": error}, None, None, None
                if found:
                    t = found[0]
                    keys = t["keyframes"]
                    codec, seconds, ranges = t.get("codec"), t.get("duration", 0) / (t.get("timescale") or 1), [{"offset": o, "length": n} for o, n in keys]
                    feature = {"codec": codec, "handler": t.get("handler"), "seconds": seconds, "samples": t["samples"], "keyframes": len(keys), "first": keys[:1], "last": keys[-1:], "ranges_crc32": zlib.crc32(np.array(keys, "<i8").tobytes())}
                rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": json.dumps(feature, separators=(",", ":")), "codec": codec, "seconds": seconds, "keyframes": ranges})
            yield pa.array(rows, DIGEST_ARROW)

    return facts(media)
