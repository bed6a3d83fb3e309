"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated probabilities.

Words are hashed to VOCABULARY rows. Each word has a sparse random index vector of two signed ones; a word's vector is the sum of its
neighbours' index vectors over all occurrences in the whole corpus, scaled to length 1. A word's shape (case, marks, digits, whether it
repeats the word before) is a word of its own with a row of its own. A document is the mean vector of its words, with the
spread, and the shares of shapes. The network is fitted on a bounded sample of labelled rows, part of which sets the temperature.

Word vectors and document vectors cover all rows and whole texts. Sent to the executors: VOCABULARY x DIMENSIONS numbers and the network.

Defined results: empty and null texts get the score of a document without words; null ids are scored but never learned from; a repeated
id is scored for each row; labels that are null teach nothing; if no label can be learned from, all scores are 0.5; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import cut_lineage, lean, mix64, text_or_empty
from corpuslens.llm.languages import remainder
from corpuslens.llm.spans import Words, flat, slices, text_buffers

VOCABULARY, DIMENSIONS, REACH = 1 << 14, 32, 2
SHAPES = 64
#: Labelled rows that the network is fitted on at most, the share of them that sets the temperature, and the network's size.
SAMPLE, CALIBRATION, HIDDEN, EPOCHS = 20_000, 0.2, 32, 60
CHUNK = 64
FEATURES = 2 * DIMENSIONS + SHAPES + 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (VOCABULARY, 2) of the ones of each word's index vector."""
    bits = mix64(np.arange(1, VOCABULARY + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    places = np.stack([bits % np.uint64(DIMENSIONS), (bits >> np.uint64(16)) % np.uint64(DIMENSIONS)], axis=1).astype(np.int64)
    signs = np.stack([(bits >> np.uint64(40)) & np.uint64(1), (bits >> np.uint64(41)) & np.uint64(1)], axis=1).astype(np.int64) * 2 - 1
    return places, signs


def _shapes(data: np.ndarray, words: Words) -> np.ndarray:
    """A number under SHAPES for each word."""
    kinds = (((data >= 65) & (data <= 90)), ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126)), (data >= 48) & (data <= 57))
    upper, marks, digits = (np.r_[0, np.cumsum(k)][words.end] - np.r_[0, np.cumsum(k)][words.start] for k in kinds)
    size = words.end - words.start
    again = np.zeros(len(size), bool)
    if len(size) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper + marks + digits < size, 2, 3)))
    return (case * 4 + np.minimum(marks, 3)) * 4 + np.minimum(digits, 1) * 2 + again


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros(VOCABULARY * DIMENSIONS, np.int64)
    for batch in batches:
        data, off = text_buffers(batch.column("t"))
        for i, j in slices(off):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            w = (words.hash % np.uint64(VOCABULARY)).astype(np.int64)
            for gap in range(1, REACH + 1):
                near = words.doc[gap:] == words.doc[:-gap]
                a, b = w[gap:][near], w[:-gap][near]
                for of, by in ((a, b), (b, a)):
                    for k in range(2):
                        total += np.bincount(of * DIMENSIONS + places[by, k], weights=signs[by, k], minlength=len(total)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOCABULARY // CHUNK, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total), CHUNK * DIMENSIONS).cast(pa.list_(pa.int64()))], ["chunk", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        rows = flat(batch.column("sums")).reshape(batch.num_rows, CHUNK * DIMENSIONS)
        for chunk, row in zip(batch.column("chunk").to_pylist(), rows, strict=True):
            total[chunk] = total.get(chunk, 0) + row
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], ["chunk", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(VOCABULARY, DIMENSIONS) unit vectors, or zero where a word never occurs; gathered over the whole corpus."""
    parts = docs.select(text_or_empty().alias("t")).mapInArrow(lean(_contexts), "chunk int, sums array<bigint>")
    out = np.zeros((VOCABULARY // CHUNK, CHUNK * DIMENSIONS))
    for row in parts.repartition("chunk").mapInArrow(_add, "chunk int, sums array<bigint>").collect():
        out[row.chunk] = row.sums
    out = out.reshape(VOCABULARY, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _pool(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("t"))
            for i, j in slices(off):
                part, n = data[off[i] : off[j]], j - i
                words = Words(part, off[i : j + 1] - off[i])
                out = np.zeros((n, FEATURES), np.float32)
                total = np.bincount(words.doc, minlength=n)
                some, each = np.flatnonzero(total), np.maximum(total, 1)[:, None]
                if len(some):
                    v = vectors[(words.hash % np.uint64(VOCABULARY)).astype(np.int64)]
                    heads = words.first[:-1][some]
                    mean = np.add.reduceat(v, heads, axis=0) / total[some, None]
                    out[some, :DIMENSIONS] = mean
                    out[some, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(np.add.reduceat(v * v, heads, axis=0) / total[some, None] - mean**2, 0))
                    shape = np.bincount(words.doc * SHAPES + _shapes(part, words), minlength=n * SHAPES).reshape(n, SHAPES)
                    out[:, 2 * DIMENSIONS : -2] = np.sqrt(shape / each)
                out[:, -2] = np.log1p(total) / 10
                out[:, -1] = np.diff(off[i : j + 1]) / each[:, 0] / 20
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    return run


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """One row per document: doc_id, x (FEATURES numbers)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).mapInArrow(lean(_pool(vectors)), "doc_id bigint, x array<float>")


@dataclass(frozen=True)
class Network:
    """Standardisation, two layers, temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network | None:
    """Adam on the log loss; then the temperature with the least log loss on rows that were set aside."""
    if len(y) == 0:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside = order[: int(len(y) * CALIBRATION)]
    train = order[len(aside) :]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for lo in range(0, len(train), 128):
            b = train[lo : lo + 128]
            h = z[b] @ p[0] + p[1]
            r = np.maximum(h, 0)
            d = (1 / (1 + np.exp(-np.clip(r @ p[2] + p[3], -40, 40))) - y[b]) / len(b)
            dh = np.outer(d, p[2]) * (h > 0)
            step += 1
            for k, g in enumerate((z[b].T @ dh + 1e-4 * p[0], dh.sum(axis=0), r.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(aside) < 20:
        return net
    logit, target = net.logits(x[aside]), y[aside]
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(target == 1, 1, -1) * logit / t))
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(min(np.geomspace(0.25, 8, 61), key=loss)))


def _score(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = flat(batch.column("x")).reshape(batch.num_rows, FEATURES)
            s = net.scores(x.astype(np.float64)) if net is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. ``sample`` bounds the labelled rows that the network is fitted on."""
    features = cut_lineage(pooled(docs, word_vectors(docs)))
    learnable = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter(remainder("doc_id", 4) != 2)
    n = learnable.count()
    if n > sample:  # a share of the ids by their hash, so that no task has to read all labelled rows for the few that are kept
        learnable = learnable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit((1 << 20) * sample // n))
    rows = features.join(learnable, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).toArrow()
    x, y = flat(rows.column("x")).reshape(rows.num_rows, FEATURES).astype(np.float64), rows.column("y").to_numpy()
    scored = features.mapInArrow(_score(fit(x, y) if len(y) else None), "doc_id bigint, score double")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
