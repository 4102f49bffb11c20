"""Toxicity by a convolutional text classifier.

Words are hashed to embeddings; filters of several widths slide over the whole
text, each keeps its maximum, and a logistic layer reads the maxima. Trained in
numpy on a bounded sample of labelled documents; thresholds by language are
calibrated on all labelled documents that are neither held out nor trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, batch_of, narrowed, text_slices, word_hashes
from barloom.session import staged

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
SLICE = 1 << 20
BINS = 64  # of log-odds, per unit


@dataclass(frozen=True)
class CnnParameters:
    """``max_rows`` labelled documents at most are drawn for training; a tenth of them is left for the thresholds.

    2**bits word buckets share embeddings of ``size`` numbers; ``filters`` of each width.
    """

    max_rows: int = 16000
    bits: int = 18
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Cnn:
    """Weights: embeddings (buckets, size), one (width * size, filters) matrix and bias per width, and the output layer."""

    p: CnnParameters
    words: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    base: float


def score_documents(docs: DataFrame, labels: DataFrame, parameters: CnnParameters = CnnParameters()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, flagged.

    Held out are documents with crc32(doc_id as text) mod 5 = 0; their labels
    are never read. A row without doc_id is not held out and has no label. Null
    or empty text has no words and gets the score of filters that found
    nothing. ``predicted`` is 1 from a score of 0.5; ``flagged`` applies the
    language's own threshold (0.5 for unknown ones). Repeated rows each get
    their row; without any usable label every score is 0.5.
    """
    model, learned = train(_drawn(docs, labels, parameters), parameters)
    # plain arrays, as classes of this package need not be known where a broadcast is read
    weights = docs.sparkSession.sparkContext.broadcast((model.words, model.kernels, model.biases, model.out, model.base))
    rows = narrowed(docs, "doc_id", "text", "lang")
    scored = staged(arrow_map(rows, _score, "doc_id long, lang string, score double", weights=weights, p=parameters))
    threshold = F.lit(0.5)
    for language, value in sorted(_thresholds(_binned(scored, labels, learned)).items()):
        threshold = F.when(F.col("lang") == language, F.lit(value)).otherwise(threshold)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= threshold).cast("int").alias("flagged"),
    )


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _known(labels: DataFrame) -> DataFrame:
    """(_id, toxic): the labels that may be read, one per id."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("toxic")).where("_id is not null and toxic is not null")
    return known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))


def _binned(scored: DataFrame, labels: DataFrame, learned: list[int]) -> list:
    """(lang, bin, least, n, toxic) of all labelled rows that training has not seen: counts, and the least score of the bin."""
    seen = scored.sparkSession.createDataFrame([(i,) for i in sorted(set(learned))], "_id long")
    unseen = _known(labels).join(F.broadcast(seen), "_id", "left_anti")
    rows = scored.where("lang is not null").join(unseen, F.col("doc_id") == F.col("_id"))
    odds = F.log(F.col("score") / (1 - F.col("score")))
    counts = rows.groupBy("lang", F.floor(odds * BINS).alias("bin")).agg(
        F.min("score").alias("least"), F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    return counts.collect()


def _drawn(docs: DataFrame, labels: DataFrame, p: CnnParameters) -> list:
    """(ids, lang, toxic) of the labelled documents with the smallest hash of their id: a bounded sample on the driver."""
    drawn = _known(labels).orderBy(F.xxhash64("_id"), "_id").limit(p.max_rows)
    rows = narrowed(docs, "doc_id", "text", "lang").join(drawn, F.col("doc_id") == F.col("_id")).select("_id", "text", "lang", "toxic")
    numbered = arrow_map(rows, _numbered, "doc_id long, ids binary, lang string, toxic int", p=p)
    # repeated documents may exceed the bound
    return sorted(numbered.limit(2 * p.max_rows).collect(), key=lambda r: (r["doc_id"], r["ids"]))


def bucket_ids(text: bytes, bits: int) -> np.ndarray:
    """Word buckets of a text; words are runs of letters and digits, lower-cased in ASCII."""
    return (word_hashes(WORD.findall(text.lower())) >> np.uint64(64 - bits)).astype(np.int32)


NUMBERED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("lang", pa.string()), ("toxic", pa.int32())])
SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])


def _numbered(batches: Iterator[pa.RecordBatch], p: CnnParameters) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        ids = [bucket_ids(t, p.bits).tobytes() for t in texts]
        yield batch_of(NUMBERED, batch.column("_id"), ids, batch.column("lang"), batch.column("toxic").cast(pa.int32()))


def _score(batches: Iterator[pa.RecordBatch], weights: Broadcast, p: CnnParameters) -> Iterator[pa.RecordBatch]:
    m = Cnn(p, *weights.value)
    for batch, texts in text_slices(batches, limit=SLICE):
        scores = predict(m, [bucket_ids(t, m.p.bits) for t in texts])
        yield batch_of(SCORED, batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), scores)


# --- the network --------------------------------------------------------------


def _fresh(p: CnnParameters) -> Cnn:
    draw = np.random.default_rng(p.seed)
    kernels = [draw.normal(0, (w * p.size) ** -0.5, (w * p.size, p.filters)).astype(np.float32) for w in p.widths]
    words = draw.normal(0, 0.1, (1 << p.bits, p.size)).astype(np.float32)
    total = len(p.widths) * p.filters
    return Cnn(p, words, kernels, [np.zeros(p.filters, np.float32) for _ in p.widths], draw.normal(0, 0.1, total).astype(np.float32), 0.0)


def _maxima(m: Cnn, texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(texts, filters) of rectified maxima, the position of each per width, and the joined ids (-1: padding)."""
    widest = max(m.p.widths)
    gap = np.full(widest, -1, np.int32)
    ids = np.concatenate([np.concatenate([t, gap]) for t in texts])
    ends = np.cumsum([len(t) + widest for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    vectors = np.where(ids[:, None] >= 0, m.words[ids], np.float32(0))
    padded = np.concatenate([vectors, np.zeros((widest, m.p.size), np.float32)])
    pooled, places = [], []
    for w, kernel, bias in zip(m.p.widths, m.kernels, m.biases):
        values = sum(padded[k : k + len(ids)] @ kernel[k * m.p.size : (k + 1) * m.p.size] for k in range(w)) + bias
        best = np.maximum.reduceat(values, starts, axis=0)
        pooled.append(np.maximum(best, 0))
        places.append((values, best, starts, ends))
    return np.concatenate(pooled, axis=1), places, ids


def predict(m: Cnn, texts: list[np.ndarray]) -> np.ndarray:
    pooled, _, _ = _maxima(m, texts)
    return 1 / (1 + np.exp(-np.clip((pooled @ m.out + m.base).astype(np.float64), -30, 30)))


def train(rows: list, p: CnnParameters) -> tuple[Cnn, list[int]]:
    """The fitted network and the ids of the documents it has seen."""
    m = _fresh(p)
    if not rows:
        m.out[:] = 0
        return m, []
    texts = [np.frombuffer(r["ids"], np.int32) for r in rows]
    y = np.array([float(r["toxic"]) for r in rows], np.float32)
    draw = np.random.default_rng(p.seed)
    order = draw.permutation(len(rows))
    learned = order[len(order) // 10 :]
    m.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    state = _Adam(m)
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        learned = draw.permutation(learned)
        for at in range(0, len(learned), p.batch):
            some = learned[at : at + p.batch]
            state.step(_gradients(m, [texts[i] for i in some], y[some]), rate)
    return m, [rows[i]["doc_id"] for i in learned]


def _gradients(m: Cnn, texts: list[np.ndarray], y: np.ndarray) -> tuple:
    p = m.p
    pooled, places, ids = _maxima(m, texts)
    error = (1 / (1 + np.exp(-np.clip(pooled @ m.out + m.base, -30, 30))) - y) / len(y)
    back = error[:, None] * m.out[None, :] * (pooled > 0)
    rows: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    kernels, biases = [], []
    for n, (w, (values, best, starts, ends)) in enumerate(zip(p.widths, places)):
        part = back[:, n * p.filters : (n + 1) * p.filters]
        text, f = np.nonzero(part)
        kernel = np.zeros_like(m.kernels[n])
        bias = part.sum(axis=0)
        if len(text):
            at = np.array([starts[t] + int(values[starts[t] : ends[t], g].argmax()) for t, g in zip(text, f)])
            g = part[text, f][:, None]
            for k in range(w):
                here = np.minimum(at + k, len(ids) - 1)
                word = np.where(at + k < len(ids), ids[here], -1)
                real = word >= 0
                vectors = np.where(real[:, None], m.words[word], np.float32(0))
                np.add.at(kernel[k * p.size : (k + 1) * p.size].T, f, g * vectors)
                rows.append(word[real])
                changes.append((g * m.kernels[n][k * p.size : (k + 1) * p.size].T[f])[real])
        kernels.append(kernel)
        biases.append(bias)
    return rows, changes, kernels, biases, pooled.T @ error, float(error.sum())


class _Adam:
    """Adam; embeddings are moved only where a batch touched them."""

    def __init__(self, m: Cnn):
        self.m, self.t = m, 0
        self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in [m.words, *m.kernels, *m.biases, m.out, np.zeros(1, np.float32)]]

    def _move(self, value: np.ndarray, at, gradient: np.ndarray, moment: tuple, rate: float) -> None:
        first, second = moment
        first[at] = 0.9 * first[at] + 0.1 * gradient
        second[at] = 0.99 * second[at] + 0.01 * gradient**2
        value[at] -= rate * first[at] / (1 - 0.9**self.t) / (np.sqrt(second[at] / (1 - 0.99**self.t)) + 1e-6)

    def step(self, gradients: tuple, rate: float) -> None:
        self.t += 1
        m, (rows, changes, kernels, biases, out, base) = self.m, gradients
        if rows and sum(map(len, rows)):
            touched, number = np.unique(np.concatenate(rows), return_inverse=True)
            gradient = np.zeros((len(touched), m.p.size), np.float32)
            np.add.at(gradient, number, np.concatenate(changes))
            self._move(m.words, touched, gradient + m.p.decay * m.words[touched], self.moments[0], rate)
        everything = slice(None)
        values = [*m.kernels, *m.biases, m.out]
        for value, gradient, moment in zip(values, [*kernels, *biases, out], self.moments[1:]):
            self._move(value, everything, gradient + m.p.decay * value, moment, rate)
        scalar = np.array([m.base], np.float32)
        self._move(scalar, everything, np.array([base], np.float32), self.moments[-1], rate)
        m.base = float(scalar[0])


def _thresholds(counts: list) -> dict[str, float]:
    """Per language the least score of the bin from which on F1 is best; 0.5 where there are no toxic examples."""
    found = {}
    for language in sorted({r["lang"] for r in counts}):
        own = sorted((r for r in counts if r["lang"] == language), key=lambda r: -r["bin"])
        toxic = np.array([r["toxic"] for r in own])
        if toxic.sum() == 0:
            found[language] = 0.5
            continue
        f1 = 2 * np.cumsum(toxic) / (np.cumsum([r["n"] for r in own]) + toxic.sum())
        found[language] = float(own[int(np.argmax(f1))]["least"])
    return found
