"""Toxicity scores from averaged subword vectors and a linear softmax.

A word is the bag of its character n-grams and itself, between marks for its start and end; each falls into a bucket
with a small vector. A word's vector is the mean over its bag, a text's the mean over its words, and a linear softmax
over it gives the score. Vectors and softmax are trained together in numpy. A misspelt word that training never saw
shares most n-grams with the word it stands for, and so most of its vector.

As everything up to the softmax is a mean, what a word adds to the difference of the two outputs is one number: scoring
looks it up, or works it out from the word's buckets, and never holds vectors of words.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_bytes

#: Labelled texts to learn from, and the longest of them: training is bounded, scoring is not.
TRAIN_DOCS = 4000
TRAIN_CHARS = 8000
#: Rows whose crc32 of the id leaves this remainder are held out.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3

GRAMS = (3, 4, 5)
BUCKET_BITS = 18
#: Texts of the sample that must hold a bucket before it gets a vector; other buckets count as zero vectors.
LEAST_TEXTS = 4
#: Words without a vector that every text is averaged with, so that a text of three words does not hang on one of them.
BLANKS = 50
DIMS = 4
STEPS = 40
RATE = 0.03
DECAY = 2.5
#: One of so many texts of the sample only tells after which step to stop.
CHECKED = 5
SEED = 13

#: Characters scored at once, and words remembered by a worker.
RUN = 1 << 18
WORDS = 1 << 20
#: Words whose buckets are worked out together in training.
WORDS_AT_ONCE = 1 << 14

_MIX = np.uint64(0x9E3779B97F4A7C15)
_OUTER = string.punctuation


def words(text: str) -> list[str]:
    return text.lower().split()


def buckets(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of each word and of the word itself, word by word, and where each word starts."""
    marked = [f"<{w.strip(_OUTER) or w}>" for w in some]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    found, owner = [], []
    rolling = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS[-1] + 1):
            rolling = rolling * _MIX
            rolling[: max(0, len(code) - n + 1)] += code[n - 1 :]
            if n >= GRAMS[0]:
                here = left >= n
                found.append(rolling[here] * np.uint64(2 * n + 1))
                owner.append(word[here])
        # Places count from the word's end, so that a word's sum does not depend on what stands before it.
        powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, _MIX, np.uint64))
        found.append(np.add.reduceat(code * powers[left], np.cumsum(size) - size) if len(code) else code)
        owner.append(np.arange(len(marked)))
        hashed = np.concatenate(found)
        hashed ^= hashed >> np.uint64(31)
        hashed *= _MIX
    order = np.argsort(np.concatenate(owner), kind="stable")
    starts = np.cumsum(np.bincount(np.concatenate(owner), minlength=len(marked))) if len(marked) else np.zeros(0, np.int64)
    return (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[order], np.r_[0, starts[:-1]].astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


class Table:
    """A sparse matrix with weights, for products with narrow dense ones (one column a row here) from either side."""

    def __init__(self, row: np.ndarray, column: np.ndarray, weight: np.ndarray, rows: int, columns: int):
        # Sorted by row, both ways, so that sums walk through memory in order.
        self.ways = []
        for a, b, n in ((row, column, rows), (column, row, columns)):
            order = np.argsort(a, kind="stable")
            filled, starts = np.unique(a[order], return_index=True)
            self.ways.append((filled, starts, b[order].astype(np.int32), weight[order].astype(np.float32), n))

    def times(self, dense: np.ndarray, back: bool = False) -> np.ndarray:
        filled, starts, other, weight, n = self.ways[back]
        out = np.zeros((len(dense), n), np.float32)
        for to, x in zip(out, dense.astype(np.float32)):
            to[filled] = _sums(x[other] * weight, starts)
        return out

    def squared(self) -> "Table":
        out = Table.__new__(Table)
        out.ways = [(*way, weight * weight, n) for *way, weight, n in self.ways]
        return out


class Model:
    """What one bucket adds to the difference of the outputs of its word, and the outputs' difference at no words."""

    def __init__(self, adds: np.ndarray, bias: float):
        self.adds, self.bias = adds, bias
        self.known: dict[str, float] = {}

    def of_words(self, some: list[str]) -> list[float]:
        found, starts = buckets(some)
        size = np.diff(np.r_[starts, len(found)])
        return (_sums(self.adds[found].astype(float), starts) / size).tolist()

    def scores(self, texts: Iterable[str]) -> Iterator[float]:
        """The score of each text, a run of texts at a time."""
        run: list[list[str]] = []
        length = 0
        for text in texts:
            run.append(words(text))
            length += len(text)
            if length >= RUN:
                yield from self._scored(run)
                run, length = [], 0
        yield from self._scored(run)

    def _scored(self, run: list[list[str]]) -> list[float]:
        new = list(set().union(*run) - self.known.keys())
        if len(self.known) + len(new) > WORDS:
            self.known = {}
            new = list(set().union(*run))
        if new:
            self.known.update(zip(new, self.of_words(new)))
        add = self.known.__getitem__
        z = np.array([self.bias + sum(map(add, bag)) / (len(bag) + BLANKS) for bag in run])
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def fit_texts(texts: list[str], toxic: list[int], steps: int = STEPS) -> Model:
    """Train on whole texts; the same texts in the same order give the same model.

    Without texts, or where all have one label, every text scores the smoothed share of toxic ones.
    """
    y = np.array(toxic, float)
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    names: dict[str, int] = {}
    column, weight, row = [], [], []
    for k, text in enumerate(texts):
        bag = Counter(words(text))
        column.append(np.fromiter((names.setdefault(w, len(names)) for w in bag), np.int32, len(bag)))
        weight.append(np.fromiter(bag.values(), np.float32, len(bag)) / (bag.total() + BLANKS))
        row.append(np.full(len(bag), k, np.int32))
    if len(y) < CHECKED or not names or y.min() == y.max():
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), bias)
    row, column, weight = np.concatenate(row), np.concatenate(column), np.concatenate(weight)
    listed, n_words = list(names), len(names)
    names.clear()
    parts = [buckets(listed[k : k + WORDS_AT_ONCE]) for k in range(0, n_words, WORDS_AT_ONCE)]
    size = np.concatenate([np.diff(np.r_[starts, len(found)]) for found, starts in parts])
    found = np.concatenate([found.astype(np.int32) for found, _ in parts])
    del listed, parts
    of_word = np.repeat(np.arange(n_words, dtype=np.int32), size)
    # A bucket is as common as its words; those of too few texts would only retell the labels of these.
    texts_with = np.bincount(column, minlength=n_words).astype(np.float32)
    often = np.bincount(found, weights=texts_with[of_word], minlength=1 << BUCKET_BITS) >= LEAST_TEXTS
    place = (np.cumsum(often) - 1).astype(np.int32)
    live = often[found]
    of_word, found = of_word[live], found[live]
    n_live = int(often.sum())
    pieces = Table(of_word, place[found], (1 / size).astype(np.float32)[of_word], n_words, n_live)
    del of_word, found, live
    texts_of = Table(row, column, weight, len(texts), n_words)
    # Buckets differ in weight by orders of magnitude; vectors are learnt in units between that weight and none.
    spread = np.sqrt(pieces.squared().times(texts_of.squared().times(np.ones((1, len(texts))), back=True), back=True) / len(texts))
    unit = np.sqrt(spread)
    rng = np.random.default_rng(SEED)
    held = {
        "vectors": rng.normal(0, 0.1, (DIMS, n_live)),
        "out": rng.normal(0, 0.1, (2, DIMS)),
        "bias": np.array([[0.0], [bias]]),
    }
    want = np.stack([1 - y, y])
    train = np.arange(len(y)) % CHECKED != 0
    best = (np.inf, held)
    mean = {k: np.zeros_like(v) for k, v in held.items()}
    square = {k: np.zeros_like(v) for k, v in held.items()}
    for step in range(1, steps + 1):
        bag = texts_of.times(pieces.times(held["vectors"] / unit))
        z = held["out"] @ bag + held["bias"]
        z = np.exp(z - z.max(0))
        z /= z.sum(0)
        loss = -np.log((z * want).sum(0)[~train] + 1e-9).mean()
        if loss < best[0]:
            best = (loss, {k: v.copy() for k, v in held.items()})
        miss = np.where(train, z - want, 0) / train.sum()
        back = pieces.times(texts_of.times(held["out"].T @ miss, back=True), back=True) / unit
        slope = {
            "vectors": back + DECAY / n_live * held["vectors"],
            "out": miss @ bag.T + DECAY / DIMS * held["out"],
            "bias": miss.sum(1, keepdims=True),
        }
        for k, g in slope.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * (g * g).mean()
            held[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-12)
    held = best[1]
    adds = np.zeros(1 << BUCKET_BITS)
    adds[often] = ((held["out"][1] - held["out"][0]) @ (held["vectors"] / unit)).ravel()
    return Model(adds.astype(np.float32), float(held["bias"][1, 0] - held["bias"][0, 0]))


def sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """At most ``train_docs`` different labelled texts that are not held out, by hash of their ids.

    Equal texts are one, toxic if any of its rows is.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    told = told.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = told.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(2 * train_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(drawn), "doc_id")  # 2 * train_docs ids
    once = texts.groupBy("text").agg(F.min(F.xxhash64("doc_id", F.lit(SEED))).alias("h"), F.max("toxic").alias("toxic"))
    rows = once.orderBy("h", "text").limit(train_docs).collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def held_out(column: str) -> Column:
    """Whether the crc32 of the id, written out, leaves the remainder of the held-out rows; false for null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from its whole text and nothing else.

    Null, empty and blank texts score what no words score; null ids are not held out and have no label; repeated rows
    each give a row; label rows without id or without a label of 0 or 1 teach nothing, and of several labels of an id or
    a text the toxic one holds. Without any usable label every score is one half. An empty table gives no rows; columns
    besides doc_id and text, and doc_id and toxic of the labels, are not read.
    """
    bounded_batches(docs.sparkSession)
    bounded_bytes(docs.sparkSession)
    found = model or fit_texts(*sample(docs, labels))
    adds, bias = found.adds, found.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(adds, bias)
        for batch in batches:
            scores = list(own.scores(x or "" for x in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
