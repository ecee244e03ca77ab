"""Quality classifier: supervised subword embeddings (operator 7).

A document is the mean of learned vectors of its features; a softmax over two classes reads the mean.
Features, all hashed into ``BUCKETS`` rows of one embedding table:

- each word (case kept),
- its character n-grams of the lengths NGRAMS, with a blank as the mark of both word ends,
- each pair of neighbouring words (the pair's bucket is the XOR of the words' hashes, so that a word
  repeated at once always falls into one bucket).

The table and the softmax weights are trained by plain stochastic gradient descent in numpy, in one
task, over a bounded sample of labelled rows: at most MAX_PER_CLASS rows of each label, those with the
smallest hash of doc_id.  Nothing but the text is a feature.

Scoring runs over whole texts in the tasks.  As mean and softmax input are linear, a bucket's part of the
logit is one number; the tasks get that vector (BUCKETS floats, a fixed size) and sum it over a document.

Defined results: null or empty text scores the bias alone; repeated rows give repeated rows; extra columns
are ignored; without any usable label (or with one class only) every score is the share of label 1, or 0.5.
Labels that contradict each other for one doc_id count as the smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCodes, batch, map_arrow, mix64, table, texts, words_of

BUCKETS = 1 << 17
DIM = 16
NGRAMS = (2, 3, 4)
MAX_PER_CLASS = 3000
EPOCHS = 3
RATE = 8.0
ACCEPT = 0.7


@dataclass(frozen=True)
class Model:
    """``weight``: each bucket's part of the logit of label 1; ``bias``: the logit of no features."""

    weight: np.ndarray
    bias: float

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


def subwords(words: list[bytes], code64: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their character n-grams, and each bucket's word (index into ``words``)."""
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    blank = c == 32
    owner = np.cumsum(blank) - 1  # a blank belongs to the word that it begins
    parts, owners = [(code64 % np.uint64(BUCKETS)).astype(np.int64)], [np.arange(len(words))]
    for n in NGRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        inner = np.zeros(m, dtype=bool)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + c[i : m + i]
            if 0 < i < n - 1:
                inner |= blank[i : m + i]
        parts.append((mix64(h[~inner]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:m][~inner])
    return np.concatenate(parts), np.concatenate(owners)


def pairs(h: np.ndarray) -> np.ndarray:
    return (mix64(h[1:] ^ h[:-1]) % np.uint64(BUCKETS)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares (32 bits each: training keeps them for its sample)."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    codes = WordCodes()
    at = codes.of(words)
    h = codes.hashes()
    own, owner = subwords(codes.words, h)
    weight = np.concatenate([np.bincount(at)[owner], np.ones(len(words) - 1)])
    found, n = np.unique(np.concatenate([own, pairs(h[at])]), return_inverse=True)
    total = np.bincount(n, weight)
    return found.astype(np.int32), (total / total.sum()).astype(np.float32)


def train(rows: list[tuple[int, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent over (label, text) rows; the list is used up."""
    labels = np.array([y for y, _ in rows], dtype=np.int64)
    share = labels.mean() if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    data = []
    while rows:  # from the last; a text goes as soon as its features are known
        data.append(features(rows.pop()[1]))
    data.reverse()
    rng = np.random.default_rng(seed)
    table_ = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            idx, w = data[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(idx):
                continue
            rows_ = table_[idx]
            mean = w @ rows_
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0  # the gradient of the logits
            table_[idx] = rows_ - (lr * w)[:, None] * (out @ p)[None, :]
            out -= (0.1 * lr) * np.outer(mean, p)
            bias -= 0.01 * lr * p
    return Model((table_ @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Rows that never teach: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, quality, text of the bounded, deterministic sample: per class the smallest hashes of doc_id."""
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    picked = [one.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows
    return texts(docs).join(ids, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Model:
    """Trains on the sample in one task (2 * per_class rows at most); the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "quality", "text")), strict=True)]
        rows.sort()
        rows = [(quality, text) for _, quality, text in rows]
        model = train(rows)
        yield batch(weight=pa.array([model.weight.tobytes()], pa.binary()), bias=pa.array([model.bias], pa.float64()))

    found = map_arrow(training_rows(docs, labels, per_class).repartition(1), run, "weight binary, bias double").first()
    return train([]) if found is None else Model(np.frombuffer(found["weight"], np.float32), found["bias"])


class Scorer:
    """Scores texts; keeps the sums of the distinct words it has met lately."""

    def __init__(self, model: Model):
        self.model, self.codes = model, WordCodes()
        self.total = self.count = np.empty(0)

    def __call__(self, found: list[str]) -> np.ndarray:
        if self.codes.trim():
            self.total = self.count = np.empty(0)
        split = [self.codes.of(words_of(t)) for t in found]
        code64, old = self.codes.hashes(), len(self.total)
        if new := self.codes.words[old:]:
            buckets, owner = subwords(new, code64[old:])
            self.total = np.concatenate([self.total, np.bincount(owner, self.model.weight[buckets], len(new))])
            self.count = np.concatenate([self.count, np.bincount(owner, minlength=len(new))])
        logits = np.full(len(split), self.model.bias)
        for i, at in enumerate(split):
            if len(at):
                s = self.total[at].sum() + self.model.weight[pairs(code64[at])].sum()
                logits[i] += s / (self.count[at].sum() + len(at) - 1)
        return self.model.score(logits)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [t or "" for t in b.column("text").to_pylist()]
            yield b.append_column(name, pa.array(scorer(found), pa.float64()))

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; the model is trained when this is called."""
    model = fit(docs, labels, per_class)
    return scored(texts(docs), model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(docs, labels, per_class)
    name = next(f"score{i}" for i in range(len(docs.columns) + 1) if f"score{i}" not in docs.columns)
    return scored(docs, model, name).where(F.col(name) >= ACCEPT).drop(name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

