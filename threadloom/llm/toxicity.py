"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Only documents have labels; a sentence's score is a logistic function of its words, the
document's score is the noisy-or of its sentences, and the weights follow from the documents' labels through it. So the
sentences that make a document toxic come out as those with a high score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .languages import bare
from .shared import kept, named, ship_package, slices

#: Labelled documents that are learned from, about so many; the sample is drawn by a hash of the id.
TRAIN_DOCS = 12_000
#: A word's features: itself and its first letters, so that other endings of a learned stem count too.
PREFIXES = range(3, 8)
#: Features of the model: those in so many labelled documents at least, and in more toxic ones than their share by at least
#: so many standard deviations, the most telling ones first.
MIN_DOCS = 4
MIN_DEVIATION = 5.0
MODEL_FEATURES = 4096
STEPS = 200
RATE = 0.1
DECAY = 2e-3
THRESHOLD = 0.3
SLICE_CHARS = 500_000
MAX_WORDS = 100_000

#: Stands for a line feed, which ends a sentence.
FEED = ""
END = re.compile(r"[.!?]+[\"'”’)\]]*$")


@dataclass
class Model:
    """Weights of features and the bias of a sentence."""

    weights: dict[str, float]
    bias: float
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def traits(word: str) -> list[str]:
    """A word's features; a whole word ends with a space."""
    return [f"{word} ", *(word[:n] for n in PREFIXES if n <= len(word))]


class Lexicon(dict):
    """Raw word to its row: the weight of what it is without punctuation, and whether a sentence ends after it."""

    def __missing__(self, word: str) -> int:
        letters = bare(word)
        self.weight.append(sum(self.model.weights.get(x, 0.0) for x in traits(letters)) if letters else 0.0)
        self.kind.append(self.kinds.setdefault(letters, len(self.weight) - 1))
        self.ends.append(word == FEED or END.search(word) is not None)
        self[word] = n = len(self.weight) - 1
        return n


def tokens(text: str) -> list[str]:
    return text.lower().replace("\n", f" {FEED} ").split()


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.seen = Lexicon()
        self.seen.model, self.seen.weight, self.seen.ends, self.seen.kind, self.seen.kinds = self.model, [], [], [], {}

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit of every sentence, its text, and its first word and end; a text without words is one empty sentence."""
        if len(self.seen) > MAX_WORDS:
            self.reset()
        number = self.seen.__getitem__
        rows = [np.fromiter(map(number, tokens(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        lens = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        weight, ends = np.array(self.seen.weight, np.float64), np.array(self.seen.ends, bool)
        kind = np.array(self.seen.kind, np.int64)  # the row of the first word with the same letters
        owner = np.repeat(np.arange(len(rows)), lens)
        if len(flat):
            stop = ends[flat].copy()
            stop[np.cumsum(lens)[lens > 0] - 1] = True
            last = np.flatnonzero(stop)
            first = np.append(0, last[:-1] + 1)
            # a word counts once a sentence
            sentence = np.cumsum(stop) - stop
            telling = np.flatnonzero(weight[flat])
            width = len(weight)
            pairs = np.unique(sentence[telling] * width + kind[flat[telling]])
            logit = np.bincount(pairs // width, weight[pairs % width], len(first)) + self.model.bias
            texts_of, begin = owner[first], first - (np.cumsum(lens) - lens)[owner[first]]
            size = last - first + 1
        else:
            logit, texts_of, begin, size = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        empty = np.flatnonzero(lens == 0)
        order = np.argsort(np.concatenate([texts_of, empty]), kind="stable")
        return tuple(np.concatenate(x)[order] for x in ((logit, np.full(len(empty), self.model.bias)), (texts_of, empty), (begin, np.zeros(len(empty), np.int64)), (size, np.zeros(len(empty), np.int64))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Noisy-or over each text's sentences."""
        logit, owner, _, _ = self.sentences(texts)
        return -np.expm1(-np.bincount(owner, softplus(logit), len(texts)))


def fitted(texts: list[str], labels: np.ndarray) -> Model:
    """Weights that fit documents' labels through the noisy-or, by Adam over all documents at once."""
    y = np.asarray(labels, np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bags: list[list[set[str]]] = []
    for text in texts:
        bag: list[set[str]] = [set()]
        for w in tokens(text):
            if letters := bare(w):
                bag[-1].add(letters)
            if (w == FEED or END.search(w)) and bag[-1]:
                bag.append(set())
        bags.append([s for s in bag if s] or [set()])
    mean_sentences = np.mean([len(b) for b in bags]) if bags else 1.0
    start = math.log(math.expm1(max(1e-4, -math.log1p(-min(rate, 0.5)) / mean_sentences)))
    if not bags or y.min() == y.max():
        return Model({}, start)
    toxic: Counter[str] = Counter()
    for bag, label in zip(bags, y, strict=True):
        if label:
            toxic.update({x for w in set().union(*bag) for x in traits(w)})
    likely = {x for x, n in toxic.items() if n >= MIN_DEVIATION / 2}
    of_word: dict[str, list[str]] = {}
    found: Counter[str] = Counter()
    for bag in bags:
        here: set[str] = set()
        for w in set().union(*bag):
            if w not in of_word:
                of_word[w] = [x for x in traits(w) if x in likely]
            here.update(of_word[w])
        found.update(here)
    # how far a feature's toxic documents lie above what their share would give, in standard deviations
    telling = sorted(((toxic[x] - n * rate) / math.sqrt(n * rate * (1 - rate)), x) for x, n in found.items() if n >= MIN_DOCS)
    telling = sorted((t for t in telling if t[0] >= MIN_DEVIATION), key=lambda t: (-t[0], t[1]))[:MODEL_FEATURES]
    column = {x: k for k, (_, x) in enumerate(telling)}
    of_column = {w: c for w, xs in of_word.items() if (c := [column[x] for x in xs if x in column])}
    flat, sentence, owner = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            for w in sorted(s & of_column.keys()):
                flat += of_column[w]
                sentence += [len(owner)] * len(of_column[w])
            owner.append(d)
    flat, sentence, owner = np.array(flat, np.int64), np.array(sentence, np.int64), np.array(owner, np.int64)
    w, b = np.zeros(len(column)), start
    m, v = np.zeros(len(column) + 1), np.zeros(len(column) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, w[flat], len(owner)) + b
        q = np.maximum(np.bincount(owner, softplus(z), len(y)), 1e-12)
        slope = np.where(y > 0, -1 / np.expm1(q), 1.0) / len(y)
        dz = slope[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(flat, dz[sentence], len(w)) + DECAY * w / len(w), dz.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({x: float(w[k]) for x, k in column.items()}, float(b))


def held_out(key: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether the CRC-32 of the key as text leaves fold; null keys count as held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(True))


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_docs: int = TRAIN_DOCS) -> Model:
    """Fits about max_docs of the labelled documents, whole texts, in one task that holds no more than these.

    The labels of the sample, max_docs rows, are broadcast to the texts; rows without a key or label are left out, of
    several labels of a key the highest counts, of several texts the first in order. The driver gets MODEL_FEATURES weights.
    """
    ship_package(df.sparkSession)
    known = labels.filter(named(key).isNotNull() & named(label).isNotNull()).groupBy(named(key).alias("k")).agg(F.max(named(label)).cast("int").alias("y"))
    n = known.count()
    if n > max_docs:
        known = known.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.lit(math.ceil(max_docs / n * (1 << 20))))
    texts = df.select(named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("text")).join(F.broadcast(known), "k")
    sample = texts.groupBy("k", "y").agg(F.min("text").alias("text")).select("k", "text", "y")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[0])
        model = fitted([r[1] for r in rows], np.array([r[2] for r in rows], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([None, *model.weights], pa.string()), pa.array([model.bias, *model.weights.values()], pa.float64())], names=["word", "weight"])

    found = sample.repartition(1).mapInArrow(fit, "word string, weight double").collect()
    return Model({r.word: r.weight for r in found if r.word is not None}, next((r.weight for r in found if r.word is None), -5.0))


def scorer_of(model: Model) -> Scorer:
    return kept(("scorer", model.token), lambda: Scorer(model))


def toxicity(df: DataFrame, model: Model, text: Column) -> Column:
    """Score of each text, 0 to 1; null and empty texts have the score of one sentence without words."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(scorer.score(part) for part in slices(batch, SLICE_CHARS))]), pa.float64())

    return score(text)


def offending(df: DataFrame, model: Model, text: Column, threshold: float = THRESHOLD) -> Column:
    """Sentences of each text with a score of threshold or more: number, words (lower case, joined by spaces) and score."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("words", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<sentence:int,words:string,score:double>>")
    def locate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            rows: list[list[dict]] = []
            for part in slices(batch, SLICE_CHARS):
                logit, owner, begin, size = scorer.sentences(part)
                here: list[list[dict]] = [[] for _ in part]
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                p = 1 / (1 + np.exp(-logit))
                for k in np.flatnonzero(p >= threshold):
                    words = tokens(part[owner[k]] or "")[begin[k] : begin[k] + size[k]]
                    here[owner[k]].append({"sentence": int(number[k]), "words": " ".join(w for w in words if w != FEED), "score": float(p[k])})
                rows += here
            yield pa.array(rows, kind)

    return locate(text)


def with_toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", prefix: str = "", threshold: float = THRESHOLD, with_sentences: bool = True) -> DataFrame:
    """df with held_out, score, predicted and, with_sentences, the offending sentences; learned from labels not held out.

    Null and empty texts have the score of one sentence without words. Rows stay as they are, repeated ones too; an empty
    table gives none. Columns that bear a new column's name (after prefix) are replaced, all others stay. Without labels of
    both kinds every document has a low score.
    """
    model = learn(df, labels.filter(~held_out(named(key))), text, key, label)
    found = df.withColumn(f"{prefix}held_out", held_out(named(key))).withColumn(f"{prefix}score", toxicity(df, model, named(text)))
    found = found.withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= threshold).cast("int"))
    return found.withColumn(f"{prefix}offending", offending(df, model, named(text), threshold)) if with_sentences else found
