"""Models fitted by whole passes over blocks of feature vectors, and the steps taken between passes.

Feature vectors are packed once into blocks of `BLOCK_ROWS` rows in the shared folder. In each pass every task adds up what is
asked for over its blocks in numpy; where there are more than `GROUP` tasks their sums are added up again in groups, so that few
arrays of the model's size reach the driver, where one step is taken. Each row has the same weight, wherever it lies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a block as it is stored, rows worked on at once, and sums of tasks that are added up in one group.
BLOCK_ROWS, SLICE, GROUP = 8192, 2048, 32

_COLUMNS = ["counts", "codes", "places", "stored", "label"]
_BLOCK = ", ".join(f"{c} binary" for c in _COLUMNS)
_SUMS = "part int, total binary"


def packed(rows: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Blocks of rows, written once: how many values each row stores, these as codes end to end, the place and the value of each code
    in the block, and the labels. Few values differ within a block, so a row takes a few bytes a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                if batch.column("label").null_count:
                    raise ValueError("a row to learn from has no label")
                kind, _, places, stored = batch.column("features").flatten()
                counts, value = pc.list_value_length(stored).to_numpy().astype(np.int32), stored.flatten().to_numpy()
                full = kind.to_numpy() == 1
                if full.any():  # vectors stored in full have no list of places
                    place = np.concatenate([np.arange(n) if d else np.asarray(p, int) for d, n, p in zip(full, counts, places.to_pylist())]).astype(np.int32)
                else:
                    place = places.flatten().to_numpy()
                order = np.lexsort((value, place))
                new = np.ones(len(order), bool)
                new[1:] = (place[order][1:] != place[order][:-1]) | (value[order][1:] != value[order][:-1])
                code = np.empty(len(order), np.uint16 if new.sum() <= 1 << 16 else np.uint32)
                code[order] = np.cumsum(new) - 1
                parts = [counts, code, place[order][new].astype(np.int32), value[order][new].astype(float), batch.column("label").to_numpy().astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], _COLUMNS)

    return written(rows.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label")).mapInArrow(run, _BLOCK))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features in the places that a block has values for, these places in order, and labels, some rows at a time."""
    for row in zip(*(batch.column(c) for c in _COLUMNS)):
        counts, codes, places, stored, label = (memoryview(v.as_buffer()) for v in row)
        counts, places, stored, label = np.frombuffer(counts, np.int32), np.frombuffer(places, np.int32), np.frombuffer(stored), np.frombuffer(label)
        ends = np.concatenate([[0], np.cumsum(counts)])
        codes = np.frombuffer(codes, np.uint16 if len(codes) == 2 * ends[-1] else np.uint32)
        used, own = np.unique(places, return_inverse=True)
        for at in range(0, len(counts), SLICE):
            n = counts[at : at + SLICE]
            part = codes[ends[at] : ends[at + len(n)]]
            x = np.zeros((len(n), len(used)))
            x.ravel()[np.repeat(np.arange(len(n)) * len(used), n) + own[part]] = stored[part]
            yield x, used, label[at : at + SLICE]


def passed(blocks: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of `add(features in used places, these places, labels)`, one flat array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for some in _slices(batch):
                own = add(*some)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // GROUP], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def group(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t) for t in table.column("total").to_pylist())
        return pa.table([table.column("part").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    sums = blocks.mapInArrow(run, _SUMS)
    if blocks.rdd.getNumPartitions() > GROUP:
        sums = sums.groupBy("part").applyInArrow(group, _SUMS)
    return sum(np.frombuffer(r["total"]) for r in sums.collect())


# --- a perceptron


def _layers(flat: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights (inputs by outputs) and intercepts of each layer, as Spark's perceptron lays them out."""
    out, at = [], 0
    for i, o in zip(layers, layers[1:]):
        out.append((flat[at : at + i * o].reshape(i, o), flat[at + i * o : at + i * o + o]))
        at += i * o + o
    return out


def perceptron_sums(flat: np.ndarray, layers: Sequence[int], x: np.ndarray, used: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows, loss and gradient, summed: logistic hidden layers, softmax over two classes, cross-entropy. `used` are the places of
    the columns of x; all others are zero."""
    weights = _layers(flat, layers)
    weights[0] = weights[0][0][used], weights[0][1]
    kept = [x]
    for w, b in weights[:-1]:
        u = kept[-1] @ w
        u += b
        np.negative(u, out=u)
        with np.errstate(over="ignore"):
            np.exp(u, out=u)
        u += 1.0
        kept.append(np.divide(1.0, u, out=u))
    z = kept[-1] @ weights[-1][0] + weights[-1][1]
    rows, own = np.arange(len(label)), label.astype(int)
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    total = e.sum(1, keepdims=True)
    loss = (np.log(total[:, 0]) - z[rows, own]).sum()
    d = e / total
    d[rows, own] -= 1.0
    out = []
    for k in reversed(range(len(weights))):
        slope = np.zeros((layers[k], layers[k + 1]))
        slope[slice(None) if k else used] = kept[k].T @ d
        out.append(np.concatenate([slope.ravel(), d.sum(0)]))
        if k:
            d = d @ weights[k][0].T
            d *= kept[k]
            d *= 1.0 - kept[k]
    return np.concatenate([[len(label), loss], *reversed(out)])


def fit_perceptron(blocks: DataFrame, layers: Sequence[int], start: np.ndarray, max_iter: int, tol: float = 1e-6) -> np.ndarray:
    """Weights after at most `max_iter` steps of L-BFGS on the mean loss."""
    sc, layers = blocks.sparkSession.sparkContext, list(layers)

    def mean(flat: np.ndarray) -> tuple[float, np.ndarray]:
        told = sc.broadcast(flat)
        sums = passed(blocks, lambda x, used, y: perceptron_sums(told.value, layers, x, used, y))
        told.destroy()
        return sums[1] / sums[0], sums[2:] / sums[0]

    return lbfgs(mean, start, max_iter, tol)


# --- steps


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float, corrections: int = 10) -> np.ndarray:
    """Minimises `f`, which gives value and gradient. Ends after `max_iter` steps, where a step finds no descent, where the gradient is
    `tol` of the value, or where the values of the last 20 steps lie within `tol` of the first value."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    first, values = abs(value), [value]
    for step in range(max_iter):
        if np.linalg.norm(g) <= max(tol * abs(value), 1e-8):
            break
        d, told = -g, []
        for s, y in reversed(past):
            told.append(s @ d / (s @ y))
            d = d - told[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y / (y @ y))
        for (s, y), a in zip(past, reversed(told)):
            d = d + (a - y @ d / (s @ y)) * s
        found = _searched(f, x, d, value, g, 1.0 if past else 1.0 / np.linalg.norm(d))
        if found is None:
            break
        at, value, slope = found
        if (slope - g) @ (at - x) > 0:
            past = [*past, (at - x, slope - g)][-corrections:]
        x, g = at, slope
        if step and abs(value - max(values[-20:])) <= tol * first:
            break
        values.append(value)
    return x


def _searched(f: Callable, x: np.ndarray, d: np.ndarray, value: float, g: np.ndarray, step: float, tries: int = 20) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A point along `d` that meets the strong Wolfe conditions, found by brackets and cubics; else the lowest one tried, if lower."""
    slope = g @ d
    if not slope < 0:
        return None
    low, high, best = (0.0, value, slope), None, None
    for _ in range(tries):
        at = x + step * d
        v, own = f(at)
        s = own @ d
        if np.isfinite(v) and v < (value if best is None else best[1]):
            best = at, v, own
        if not np.isfinite(v) or v > value + 1e-4 * step * slope or v >= low[1] and low[0] > 0:
            high = step, v, s
        elif abs(s) <= 0.9 * abs(slope):
            return at, v, own
        else:
            if s * ((high[0] if high else np.inf) - low[0]) >= 0:
                high = low
            low = step, v, s
        step = 2.0 * step if high is None else _between(low, high)
    return best


def _between(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
    """The minimum of the cubic through two points and slopes, kept off their ends; the middle where there is none."""
    (a, va, sa), (b, vb, sb) = low, high
    middle = 0.5 * (a + b)
    if not np.isfinite(vb):
        return middle
    u = sa + sb - 3 * (va - vb) / (a - b)
    root = u * u - sa * sb
    if root < 0:
        return middle
    root = np.sign(b - a) * root**0.5
    if sb - sa + 2 * root == 0:
        return middle
    out = b - (b - a) * (sb + root - u) / (sb - sa + 2 * root)
    least, most = min(a, b), max(a, b)
    return float(np.clip(out, least + 0.1 * (most - least), most - 0.1 * (most - least)))
