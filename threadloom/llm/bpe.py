"""Byte-level BPE over ragged numpy arrays, and token counts.

Pre-tokens of a batch lie end to end in one symbol array. In each round every sequence applies the pair of its lowest
rank, all its places at once; sequences that have no pair left leave the arrays. What is left of a sequence are its
tokens. A pre-token is merged once a worker: texts are cut into units between which no pre-token can reach, and units
already seen are looked up.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, named, ship_package

#: Fixed values of the byte-level format: the split pattern and the printable bytes that stand for themselves.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

NONE = np.int32(2**31 - 1)
#: Texts are worked off in slices of about so many characters, and a worker's memory of units is emptied at so many.
SLICE_CHARS = 1_000_000
MAX_UNITS = 250_000


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file."""
    names = {b: chr(b) for b in PRINTABLE}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return names


class RankMerger:
    """Merges of one vocabulary file, applied to many sequences at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        names = byte_names()
        self.first = np.array([vocab[names[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = len(vocab)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # a first filter: most pairs of symbols have no merge
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(keys)] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no merge."""
        key = a.astype(np.int64) * self.width + b
        out = np.full(len(key), NONE, np.int32)
        maybe = np.flatnonzero(self.bits[self._slot(key)])
        if len(maybe):
            k = key[maybe]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            found = self.keys[at] == k
            out[maybe[found]] = self.ranks[at[found]]
        return out

    def merge(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of sequences whose bytes lie end to end in data, and the number of tokens of each sequence."""
        counts = lens.copy()
        sym = self.first[data]
        out_ids: list[np.ndarray] = []
        out_seq: list[np.ndarray] = []
        seq = np.flatnonzero(lens)
        lens = lens[seq]
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lens) - 1] = True
        rank = np.full(len(sym), NONE, np.int32)
        at = np.flatnonzero(~last)
        rank[at] = self.rank(sym[at], sym[at + 1])
        while len(sym):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                gone = np.repeat(done, lens)
                counts[seq[done]] = lens[done]
                out_ids.append(sym[gone])
                out_seq.append(np.repeat(seq[done], lens[done]))
                stay = ~gone
                sym, rank, last = sym[stay], rank[stay], last[stay]
                seq, lens, low = seq[~done], lens[~done], low[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            # of overlapping places, such as in a a a, the first, third, ... are merged
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            if not fresh.all():
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            lens = np.add.reduceat(keep, np.cumsum(lens) - lens, dtype=np.int64)
            place = hit - np.arange(len(hit))
            sym, rank, last = sym[keep], rank[keep], last[keep]
            rank[place] = NONE
            for p in (place, place[place > 0] - 1):
                p = p[~last[p]]
                rank[p] = self.rank(sym[p], sym[p + 1])
        if not out_ids:
            return np.zeros(0, np.int32), counts
        ids, owner = np.concatenate(out_ids), np.concatenate(out_seq)
        return ids[np.argsort(owner, kind="stable")], counts

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text, special strings as pieces of their own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.special_split.split(text):
            out += [part] if part in self.special else self.split.findall(part)
        return out


class Units(dict):
    """Unit to its number, in order of first sight."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


#: White space besides space and line feed, in ASCII and beyond.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_breaks(text: str) -> bool:
    """True if all white space of text is single spaces and line feeds between other characters.

    Then each space opens a pre-token and each line feed is one, so the text can be cut there.
    """
    if text[:1] in " \n" or text[-1:] in " \n" or "\x00" in text:
        return False
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in OTHER_SPACE) and (text.isascii() or not any(c in text for c in WIDE_SPACE))


class Tokens:
    """Token ids of texts; units already seen in this worker are not merged again."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.reset()

    def reset(self) -> None:
        self.units = Units()
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self) -> None:
        known = len(self.counts)
        new = list(itertools.islice(reversed(self.units), len(self.units) - known))[::-1]
        if not new:
            return
        m = self.merger
        streams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, tokens of each piece, ids
        special = np.zeros(len(new), bool)
        for s, i in m.special.items():
            k = self.units.get(s, -1) - known
            if k >= 0:
                special[k] = True
                streams.append((np.array([k]), np.array([1]), np.array([i], np.int32)))
        # one piece each: white space, and letters with or without a space before them
        blank = np.fromiter(map(str.isspace, new), bool, len(new)) & ~special
        letters = np.fromiter((u.isalpha() or u[0] == " " and u[1:].isalpha() for u in new), bool, len(new)) & ~special
        single = np.flatnonzero(blank | letters)
        if len(single):
            coded = [new[k].encode("utf-8", "replace") for k in single]
            ids, n = m.merge(np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, len(coded)))
            streams.append((single, n, ids))
        rest = np.flatnonzero(~(blank | letters | special))
        if len(rest):
            # a line feed between units is a piece of its own and changes no other piece
            joined = "\n".join(new[k] for k in rest)
            pieces = m.split.findall(joined)
            data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
            lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
            if len(data) != len(joined):
                ends = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))[np.concatenate([[0], np.cumsum(lens)])]
                lens = np.diff(ends)
            feed = data[np.cumsum(lens) - lens] == 10
            ids, n = m.merge(data[np.repeat(~feed, lens)], lens[~feed])
            streams.append((rest[np.cumsum(feed)[~feed]], n, ids))
        owner = np.concatenate([np.repeat(k, n) for k, n, _ in streams])
        counts = np.bincount(owner, minlength=len(new))
        ids = np.concatenate([x for _, _, x in streams])[np.argsort(owner, kind="stable")]
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        m = self.merger
        if any(s in text for s in m.special):
            return m.pieces(text)
        if not plain_breaks(text):
            return m.split.findall(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.units) > MAX_UNITS:
            self.reset()
        number = self.units.__getitem__
        found: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                found.extend(map(number, self._cut(text)))
            ends[k + 1] = len(found)
        self._learn()
        return np.array(found, np.int64), ends

    def _slices(self, texts: list[str | None]) -> Iterator[list[str | None]]:
        part: list[str | None] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= SLICE_CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        out = []
        for part in self._slices(texts):
            found, ends = self._numbers(part)
            total = np.concatenate([[0], np.cumsum(self.counts[found])])
            out.append(total[ends[1:]] - total[ends[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Token ids of each text, in order."""
        for part in self._slices(texts):
            found, ends = self._numbers(part)
            n = self.counts[found]
            starts = (np.cumsum(self.counts) - self.counts)[found]
            total = np.concatenate([[0], np.cumsum(n)])
            flat = self.ids[np.repeat(starts - total[:-1], n) + np.arange(total[-1])]
            cuts = total[ends]
            for k in range(len(part)):
                yield flat[cuts[k] : cuts[k + 1]]


def tokens_of(path: str) -> Tokens:
    return kept(("tokens", path), lambda: Tokens(path))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(text: Column, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """Tokens of each whole text (null or empty: 0) under a byte-level BPE vocabulary of public_tokenizers, or a path."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = tokens_of(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *(tokens.count(texts[k : k + 500].to_pylist()) for k in range(0, len(texts), 500))]), pa.int64())

    return count(text)


def with_token_counts(df: DataFrame, text: str = "text", limit: int = 512, vocabulary: str = "byte_bpe_50k.json", prefix: str = "") -> DataFrame:
    """df with n_bytes, n_tokens and over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Every row of df gives one row, repeated rows too; other columns stay,
    but columns that bear the names of the new ones (after prefix) are replaced; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    return df.withColumn(f"{prefix}n_bytes", F.coalesce(F.octet_length(named(text)), F.lit(0)).cast("long")).withColumn(f"{prefix}n_tokens", F.coalesce(token_count(named(text), vocabulary), F.lit(0)).cast("long")).withColumn(f"{prefix}over_limit", F.col(f"{prefix}n_tokens") > limit)
