"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

Learned are counts of hashed character n-grams and words by language. A word's score for a language is the logarithm of its
features' likelihood; the path over a text's words pays SWITCH for each change of language.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, named, ship_package, slices, unused

UND = "und"
BUCKETS = 1 << 16
GRAMS = 4
#: Documents that are learned from, about so many; the sample is drawn by a hash of the id.
TRAIN_DOCS = 20_000
#: Price of a change of language, in units of log-likelihood.
SWITCH = 6.0
#: n-grams of a word overlap, so their sum counts by this factor.
SCALE = 0.25
#: A word counts for its best language by this much at most, so no single one outweighs two changes.
CLIP = 10.0
#: What a language costs for a word in a script that it isn't written in: more than two changes, so no path has it.
EXCLUDED = 2 * SWITCH + CLIP
SMOOTH = 0.5
#: A script's candidates are the languages that have at least this share of their words in it.
SCRIPT_SHARE = 0.001
SLICE_CHARS = 500_000
MAX_WORDS = 100_000

#: First code points of script blocks, and the script from there to the next.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0xA4D0, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Other"), (0x20000, "Han"),
]
SCRIPT_STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF_BLOCK = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word number of every feature, and the script of each word (that of its first letter)."""
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 2) - 1
    found, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, GRAMS + 1):
        tail = len(points) - n + 1
        if tail <= 0:
            break
        h = h[:tail] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        inside = owner[n - 1 :] == owner[:tail]
        mixed = (h[inside] ^ (h[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((mixed >> np.uint64(48)).astype(np.int64))
        owners.append(owner[:tail][inside])
    found.append(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (BUCKETS - 1) for w in words), np.int64, len(words)))
    owners.append(np.arange(len(words)))
    first = np.flatnonzero(points == 2) + 1
    script = SCRIPT_OF_BLOCK[np.searchsorted(SCRIPT_STARTS, points[np.minimum(first, len(points) - 1)].astype(np.int64), "right") - 1]
    return np.concatenate(found), np.concatenate(owners), script


def bare(word: str) -> str:
    """The word without what is no letter at its ends; '' if nothing is left."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


@dataclass
class Model:
    """langs; log-likelihood of each bucket by language; which languages each script allows."""

    langs: list[str]
    loglik: np.ndarray
    allowed: np.ndarray
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = TRAIN_DOCS) -> Model:
    """Counts over about max_docs of rows, whole texts; rows without text or language are left out.

    The driver gets one count for each language and bucket that occurs, BUCKETS a language at most.
    """
    ship_package(rows.sparkSession)
    rows = rows.filter(named(lang).isNotNull() & named(text).isNotNull()).select(named(key).alias("k"), named(lang).alias("lang"), named(text).alias("text"))
    n = rows.select("k").count()
    if n > max_docs:
        rows = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.lit(math.ceil(max_docs / n * (1 << 20))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, lang in enumerate(langs):
                words = [w for w in map(bare, batch.column(1)[at].as_py().lower().split()) if w]
                if not words:
                    continue
                bucket, _, script = features(words)
                sums = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                sums += np.bincount(np.concatenate([bucket, BUCKETS + script]), minlength=len(sums))
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(sums[at])], names=["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in counted})
    sums = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    for r in counted:
        sums[r.bucket, place[r.lang]] = r.n
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    loglik = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * BUCKETS)).astype(np.float32) * np.float32(SCALE)
    allowed = scripts >= SCRIPT_SHARE * scripts.sum(0)
    allowed &= scripts > 0
    allowed[~allowed.any(1)] = True
    return Model(langs, loglik, allowed)


class Speller(dict):
    """Word to its row of scores; row 0 is for words without letters."""

    def __missing__(self, word: str) -> int:
        letters = bare(word)
        if not letters:
            n = 0
        elif letters != word:
            n = self[letters]
        else:
            n = self.rows
            self.rows += 1
            self.new.append(word)
        self[word] = n
        return n


class Tagger:
    """Viterbi over words of many texts at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.seen = Speller()
        self.seen.rows, self.seen.new = 1, []
        self.score = np.zeros((1, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1, np.int64)

    def _learn(self) -> None:
        if not self.seen.new:
            return
        words, self.seen.new = self.seen.new, []
        bucket, owner, script = features(words)
        score = np.stack([np.bincount(owner, self.model.loglik[bucket, k], len(words)) for k in range(len(self.model.langs))], 1)
        allowed = self.model.allowed[script]
        best = np.where(allowed, score, -np.inf).max(1, keepdims=True)
        score = np.where(allowed, np.maximum(np.minimum(score - best, 0), -CLIP), -EXCLUDED)
        self.score = np.concatenate([self.score, score.astype(np.float32)])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, words), np.int64, len(words))])

    def paths(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: language number of every word, rows of its words, and the sum of scores by language."""
        if len(self.seen) > MAX_WORDS:
            self.reset()
        number = self.seen.__getitem__
        rows = [np.fromiter(map(number, t.lower().split()), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        self._learn()
        n_langs = len(self.model.langs)
        out: list = [None] * len(rows)
        lens = np.array([len(r) for r in rows], np.int64)
        full = np.flatnonzero(lens)
        for k in np.flatnonzero(lens == 0):
            out[k] = (np.zeros(0, np.int16), rows[k], np.zeros(n_langs))
        if not len(full):
            return out
        flat = np.concatenate([rows[k] for k in full])
        ends = np.cumsum(lens[full])
        first = ends - lens[full]
        gain = self.score[flat].astype(np.float64)
        total = np.add.reduceat(gain, first)
        main = total.argmax(1)
        for k in np.flatnonzero(self.one_language(gain, first, lens[full], main)):
            out[full[k]] = (np.full(lens[full[k]], main[k], np.int16), rows[full[k]], total[k])
        rest = np.array([k for k in full if out[k] is None], np.int64)
        for k, path in zip(rest, self.viterbi([rows[k] for k in rest]), strict=True):
            out[k] = (path, rows[k], total[np.searchsorted(full, k)])
        return out

    @staticmethod
    def one_language(gain: np.ndarray, first: np.ndarray, lens: np.ndarray, main: np.ndarray) -> np.ndarray:
        """Texts whose best path surely has no change: no span gains more outside the main language than changes cost.

        A span at an end of the text needs one change, any other two, so three largest sums tell.
        """
        if gain.shape[1] < 2:
            return np.ones(len(first), bool)
        own = np.repeat(main, lens)
        at = np.arange(len(gain))
        base = gain[at, own].copy()
        gain[at, own] = -np.inf
        sums = np.cumsum(gain.max(1) - base)
        before = np.concatenate([[0.0], sums[:-1]])
        start = before[first]
        rise = sums - np.repeat(start, lens)
        fall = before - np.repeat(start, lens)
        # a lower level for each text makes the running least of all texts one of its own
        level = np.repeat(np.arange(len(first)) * (2 * EXCLUDED * lens.max() + 1), lens)
        least = np.minimum.accumulate(fall - level) + level
        ahead = np.maximum.reduceat(rise, first)
        behind = rise[first + lens - 1] - np.minimum.reduceat(fall, first)
        inside = np.maximum.reduceat(rise - least, first)
        return (ahead <= SWITCH) & (behind <= SWITCH) & (inside <= 2 * SWITCH)

    def viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Best path of each text, all texts a word at a time."""
        if not rows:
            return []
        n_langs = len(self.model.langs)
        lens = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(-lens, kind="stable")
        ends = np.cumsum(lens[order])
        first = ends - lens[order]
        flat = np.concatenate([rows[k] for k in order])
        stay = np.zeros((len(flat), n_langs), bool)
        best = np.zeros(len(flat), np.int16)
        path = np.zeros(len(flat), np.int16)
        value = np.zeros((len(rows), n_langs), np.float32)
        longest = int(lens.max()) if len(lens) else 0
        active = np.searchsorted(-lens[order], -np.arange(longest), "left")  # texts longer than t
        for t in range(longest):
            m = active[t]
            at = first[:m] + t
            v = value[:m]
            if t:
                top = v.argmax(1)
                floor = v[np.arange(m), top][:, None] - np.float32(SWITCH)
                keep = v >= floor
                stay[at] = keep
                best[at] = top
                v = np.where(keep, v, floor)
                v -= v.max(1, keepdims=True)
            value[:m] = v + self.score[flat[at]]
        state = value.argmax(1)
        for t in range(longest - 1, -1, -1):
            m = active[t]
            at = first[:m] + t
            s = state[:m]
            path[at] = s
            if t:
                state[:m] = np.where(stay[at, s], s, best[at])
        out: list = [None] * len(rows)
        for k, j in enumerate(order):
            out[j] = path[first[k] : ends[k]]
        return out


def tagger_of(model: Model) -> Tagger:
    return kept(("tagger", model.token), lambda: Tagger(model))


LABELS = "struct<lang:string,score:double,spans:array<struct<lang:string,word:int,words:int>>>"
SPAN = pa.struct([("lang", pa.string()), ("word", pa.int32()), ("words", pa.int32())])
LABELS_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])


def spans_of(paths: list[np.ndarray], langs: pa.Array) -> pa.Array:
    """Runs of one language in each path, as a list column."""
    lens = np.fromiter(map(len, paths), np.int64, len(paths))
    flat = np.concatenate([np.zeros(0, np.int16), *paths])
    first = np.cumsum(lens) - lens
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    new[first[lens > 0]] = True
    cut = np.flatnonzero(new)
    owner = np.repeat(np.arange(len(paths)), lens)[cut]
    runs = pa.StructArray.from_arrays(
        [langs.take(pa.array(flat[cut], pa.int64())), pa.array(cut - first[owner], pa.int32()), pa.array(np.diff(np.append(cut, len(flat))), pa.int32())],
        fields=list(SPAN),
    )
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(paths))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)


def labelled(tagger: Tagger, texts: list[str | None]) -> pa.StructArray:
    """Struct of lang, score and spans of each text."""
    langs = tagger.model.langs
    names = pa.array([*langs, UND], pa.string())
    top = np.full(len(texts), len(langs), np.int64)
    score = np.zeros(len(texts))
    paths = [np.zeros(0, np.int16)] * len(texts)
    for k, (path, words, total) in enumerate(tagger.paths(texts) if langs else ()):
        letters = tagger.letters[words]
        if not letters.any():
            continue
        share = np.bincount(path, letters, len(langs))
        # of languages with as many letters, the one with the higher sum of scores
        best = top[k] = max(range(len(langs)), key=lambda x: (share[x], total[x]))
        margin = total[best] - max((x for j, x in enumerate(total) if j != best), default=-np.inf)
        score[k] = 0.5 * share[best] / share.sum() + 0.5 * max(0.0, np.tanh(margin / (2 * CLIP)))
        paths[k] = path
    return pa.StructArray.from_arrays([names.take(pa.array(top)), pa.array(np.clip(score, 0.0, 1.0)), spans_of(paths, names)], fields=list(LABELS_ARROW))


def identify(df: DataFrame, model: Model, text: Column) -> Column:
    """Struct of lang, score and spans of each text.

    spans: runs of words (numbered from 0, between white space) of one language, along the best path. lang: the language with
    the most letters on that path; und for null texts and those without a letter, with score 0 and no spans, and for all
    where nothing was learned. score: half the share of letters in spans of that language, and half for how far the sum of
    its word scores is ahead of every other one.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(LABELS)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = tagger_of(shared.value)
        for batch in batches:
            done = [labelled(tagger, part) for part in slices(batch, SLICE_CHARS)]
            yield pa.concat_arrays(done) if done else pa.array([], LABELS_ARROW)

    return label(text)


def held_out(key: Column, fold: int = 1, folds: int = 3) -> Column:
    """Whether the CRC-32 of the key as text leaves fold; null keys count as held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(True))


def with_languages(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", prefix: str = "") -> DataFrame:
    """df with held_out, lang_pred, score and lang_spans, learned from df's rows that aren't held out.

    Null, empty and letterless texts are und, with score 0 and no spans. Rows stay as they are, repeated ones too; an empty
    table gives none. Columns that bear a new column's name (after prefix) are replaced, all others stay.
    """
    model = learn(df.filter(~held_out(named(key))), text, lang, key)
    label = unused(df, "label")
    found = df.withColumn(f"{prefix}held_out", held_out(named(key))).withColumn(label, identify(df, model, named(text)))
    return found.withColumns({f"{prefix}lang_pred": F.col(label)["lang"], f"{prefix}score": F.col(label)["score"], f"{prefix}lang_spans": F.col(label)["spans"]}).drop(label)
