"""A quality classifier: a byte-level convolutional network in numpy.

Every byte of a text gets an embedding. Chunks of `CHUNK` bytes start every CHUNK // 2 bytes, so they overlap and cover the whole
text. Learned filters score each chunk, rectified; each filter is pooled to its maximum over all chunks of the text, and a
logistic unit combines the maxima into one probability. Because the chunks of a batch lie end to end, the filters of a whole
batch are two matrix products, of first and of second halves of chunks, and the pools are segment reductions; they are taken
slab by slab, so memory is bounded for texts of any length.

Bounds: the net is learned from at most `LABELLED_ROWS` labelled rows whose texts have at most `TRAIN_BYTES` bytes each; the
scores cover all rows and whole texts of any length.

Edge cases: null text counts as empty; a text is padded with zero bytes to whole chunks, so even an empty text has one;
without labelled rows, or with one label alone, all scores are nearly the same; a null label or doc_id is not learned from;
of rows that share an id the smallest text is learned from; rows that repeat are scored each; other input columns are ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, one_text_each, steps, text_bytes
from .linear import fit_logistic, sigmoid

FOLDS, HELD_OUT = 3, 1
LABELLED_ROWS, TRAIN_BYTES = 3_000, 1 << 16
CHUNK, EMBEDDING, FILTERS = 64, 6, 32
HALF = CHUNK // 2

#: Halves of chunks that are scored at once.
SLAB = (1 << 20) // HALF

#: Learning: passes over the sample, texts in a step, step size.
PASSES, STEP_TEXTS, RATE, SEED = 6, 32, 0.01, 7


def halves(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts padded to whole halves of chunks, at least two each, end to end; and the first half of each text (one more)."""
    sizes = np.diff(at)
    first = np.concatenate([[0], np.cumsum(np.maximum(2, -(-sizes // HALF)))])
    padded = np.zeros(first[-1] * HALF, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first[:-1] * HALF - at[:-1], sizes)] = data
    return padded.reshape(-1, HALF), first


@dataclass
class Net:
    embedding: np.ndarray
    filters: np.ndarray  # (2, HALF * EMBEDDING, FILTERS): for the first and the second half of a chunk
    bias: np.ndarray
    weights: np.ndarray = None
    out_bias: float = 0.0

    @classmethod
    def fresh(cls) -> Net:
        rng = np.random.default_rng(SEED)
        width = HALF * EMBEDDING
        filters = rng.normal(0, 1 / np.sqrt(2 * width), (2, width, FILTERS))
        return cls(rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), filters.astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)

    def _chunks(self, padded: np.ndarray, crossing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embedded halves, and the rectified filters of the chunk that starts at each half but the last; chunks that would
        reach into the next text count as nothing."""
        x = self.embedding[padded].reshape(len(padded), HALF * EMBEDDING)
        act = np.maximum((x @ self.filters[0])[:-1] + (x @ self.filters[1])[1:] + self.bias, 0)
        act[crossing] = 0
        return x, act

    def pooled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        padded, first = halves(data, at)
        out = np.zeros((len(at) - 1, FILTERS))
        for a in range(0, len(padded) - 1, SLAB):
            b = min(a + SLAB, len(padded) - 1)  # chunks a to b
            inner = first[(first > a) & (first < b)]
            begin = np.concatenate([[a], inner])
            ends = first[1:-1] - 1
            _, act = self._chunks(padded[a : b + 1], ends[(ends >= a) & (ends < b)] - a)
            rows = np.searchsorted(first, begin, side="right") - 1
            out[rows] = np.maximum(out[rows], np.maximum.reduceat(act, begin - a))
        return out

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sigmoid(self.pooled(data, at) @ self.weights + self.out_bias)

    def gradients(self, data: np.ndarray, at: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, for embedding, filters, bias, weights and output bias."""
        padded, first = halves(data, at)
        x, act = self._chunks(padded, first[1:-1] - 1)
        pooled = np.maximum.reduceat(act, first[:-1])
        gap = ((sigmoid(pooled @ self.weights + self.out_bias) - y) / len(y)).astype(np.float32)
        rows = np.repeat(np.arange(len(y)), np.diff(first))[:-1]
        d_pool = gap[:, None] * self.weights
        d = np.where((act == pooled[rows]) & (act > 0), d_pool[rows], 0).astype(np.float32)
        d_x = np.zeros_like(x)
        d_x[:-1] += d @ self.filters[0].T
        d_x[1:] += d @ self.filters[1].T
        flat = d_x.reshape(-1, EMBEDDING)
        d_embedding = np.column_stack([np.bincount(padded.ravel(), weights=flat[:, k], minlength=256) for k in range(EMBEDDING)])
        return [d_embedding.astype(np.float32), np.stack([x[:-1].T @ d, x[1:].T @ d]), d.sum(0), pooled.T @ gap, gap.sum()]


def train(texts: list[bytes], y: np.ndarray) -> Net:
    """Adam over the sample in a fixed shuffled order, then the last layer once more, to its optimum."""
    net = Net.fresh()
    if not len(texts):
        return net
    rng, sizes = np.random.default_rng(SEED), np.array([len(t) for t in texts])
    names = ("embedding", "filters", "bias", "weights", "out_bias")
    first, second, step = [0.0] * 5, [0.0] * 5, 0
    for _ in range(PASSES):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), STEP_TEXTS):
            pick = order[a : a + STEP_TEXTS]
            data = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
            found = net.gradients(data, np.concatenate([[0], np.cumsum(sizes[pick])]), y[pick].astype(np.float32))
            step += 1
            for k, (name, g) in enumerate(zip(names, found)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - (move.astype(np.float32) if hasattr(move, "astype") else move))
    pooled = np.concatenate([net.pooled(np.frombuffer(b"".join(texts[a : a + 256]), np.uint8), np.concatenate([[0], np.cumsum(sizes[a : a + 256])])) for a in range(0, len(texts), 256)])
    net.weights, net.out_bias = fit_logistic(pooled, y.astype(float), ridge=0.1)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net:
    """Learns from a bounded sample of labelled rows (labels: doc_id and the label); the net is trained on the driver."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).join(F.broadcast(sample), "doc_id")
    found = one_text_each(rows).orderBy("doc_id").toArrow()  # at most LABELLED_ROWS rows
    return train([t.encode() for t in found.column("text").to_pylist()], found.column("label").to_numpy().astype(int))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score, the probability of label 1, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.score(*text_bytes(batch.column("text"))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, net: Net, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 20):
            yield batch.filter(pa.array(net.score(*text_bytes(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def training_fold(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
