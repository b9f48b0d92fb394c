"""Click models of embeddings fitted end to end: learned attention over behaviours, cross layers, and a wide part.

A row has scalar values (user, ad, context), target values, the history of these target values, and numbers. All values share
one table of vectors, in which each is found by a hash of its field and text, so the model's size is a parameter and no
dictionary is needed. Every behaviour of the history is scored against the target by two hidden layers over the four-part
input (target, behaviour, difference, product); softmax weights add the behaviours up to an interest. Values, target,
interest and numbers then pass two hidden layers with learned slopes to a logit. Low-rank cross layers may stand before the
hidden layers, each multiplying the input with a mix of the layer before; a wide part, one weight for each hashed value of its
own columns and a linear term, may be added to the logit and is fitted together with the rest. Without targets the model is
one of scalar values and numbers alone.

Rows are prepared once and kept in the shared folder. In each round all tasks get the parameters, add up loss and gradient
over blocks of their rows, and partial sums are added up again in groups before a few reach the driver, where one step of the
optimiser is taken. A round reads one shard of the rows; shards are dealt by hash, so every row is used once in each pass.

Edge cases: a missing value is a value of its own; a missing number counts as the training mean; an empty or missing history
has a zero interest; items of the histories are matched by position, and the shortest list of a row sets the length; rows
without a label are scored but not learned from; an empty training table gives the initial model."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import written
from .encode import fit_moments

#: Rows whose histories are worked on at once, and partial sums that are added up in one group.
BLOCK_ROWS, GROUP = 512, 32

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Inputs:
    """Column names: scalar values, target values with their history columns, and numbers; values and numbers of the wide part."""

    scalars: Sequence[str]
    targets: Mapping[str, str]
    dense: Sequence[str]
    label: str = "clk"
    wide: Sequence[str] = ()
    wide_dense: Sequence[str] = ()


@dataclass(frozen=True)
class Shape:
    """Places in the table of vectors and in that of wide weights, the vectors' width, the widths of the hidden layers, and the number
    and rank of cross layers."""

    places: int = 1 << 14
    width: int = 8
    scorer: tuple[int, int] = (16, 8)
    hidden: tuple[int, int] = (64, 32)
    cross: int = 0
    rank: int = 32

    def start(self, inputs: Inputs, seed: int = 0) -> Params:
        rng = np.random.default_rng(seed)
        b = self.width * len(inputs.targets)
        first = self.width * len(inputs.scalars) + 2 * b + len(inputs.dense)
        layer = lambda i, o: rng.normal(0, (2.0 / (i + o)) ** 0.5, (i, o))
        (s1, s2), (h1, h2) = self.scorer, self.hidden
        crossed = {f"c{k}{part}": value for k in range(self.cross) for part, value in (("v", layer(first, self.rank)), ("u", layer(self.rank, first)), ("b", np.zeros(first)))}
        wide = {"w": np.zeros(self.places), "wd": np.zeros(len(inputs.wide_dense))} if inputs.wide or inputs.wide_dense else {}
        return crossed | wide | {
            "table": rng.normal(0, 0.1, (self.places, self.width)),
            "s1": layer(4 * b, s1), "s1b": np.zeros(s1), "s2": layer(s1, s2), "s2b": np.zeros(s2), "s3": layer(s2, 1)[:, 0], "s3b": np.zeros(1),
            "h1": layer(first, h1), "h1b": np.zeros(h1), "h1a": np.full(1, 0.25), "h2": layer(h1, h2), "h2b": np.zeros(h2), "h2a": np.full(1, 0.25), "h3": layer(h2, 1)[:, 0], "h3b": np.zeros(1),
        }


@dataclass
class Block:
    """Rows as arrays: places of the scalar and target values, of all behaviours end to end with their row, numbers, labels."""

    scalars: np.ndarray
    targets: np.ndarray
    items: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    label: np.ndarray
    wide: np.ndarray | None = None
    wide_dense: np.ndarray | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.exp(-x)
    out += 1.0
    return np.divide(1.0, out, out=out)


def _by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of the items of each row; items come in row order."""
    out = np.zeros((n, *values.shape[1:]))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(values, first, 0)
    return out


def forward(p: Params, block: Block) -> tuple[np.ndarray, dict]:
    """The logit of each row, and what `backward` needs."""
    n, row = len(block.targets), block.row
    target = p["table"][block.targets].reshape(n, -1)
    items = p["table"][block.items].reshape(len(row), target.shape[1])
    times, (w1, w2, w3, w4) = target[row] * items, np.split(p["s1"], 4)
    u = items @ (w2 - w3)  # the input (target, item, target - item, product), whose target part is one product a row
    u += times @ w4
    u += (target @ (w1 + w3) + p["s1b"])[row]
    a1 = _sigmoid(u)
    a2 = _sigmoid(a1 @ p["s2"] + p["s2b"])
    s = (a2 @ p["s3"] + p["s3b"]) / np.sqrt(max(target.shape[1], 1))
    most = np.zeros(n)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        most[row[first]] = np.maximum.reduceat(s, first)
    e = np.exp(s - most[row])
    weight = e / np.bincount(row, e, n)[row]
    interest = _by_row(weight[:, None] * items, row, n)
    x = np.concatenate([p["table"][block.scalars].reshape(n, -1), target, interest, block.dense], 1)
    crossed, mixed = [x], []
    while f"c{len(mixed)}v" in p:
        k = len(mixed)
        mixed.append((crossed[k] @ p[f"c{k}v"]) @ p[f"c{k}u"] + p[f"c{k}b"])
        crossed.append(x * mixed[k] + crossed[k])
    u1 = crossed[-1] @ p["h1"] + p["h1b"]
    v1 = np.where(u1 > 0, u1, p["h1a"] * u1)
    u2 = v1 @ p["h2"] + p["h2b"]
    v2 = np.where(u2 > 0, u2, p["h2a"] * u2)
    logit = v2 @ p["h3"] + p["h3b"]
    if "w" in p:
        logit = logit + p["w"][block.wide].sum(1) + block.wide_dense @ p["wd"]
    return logit, {"crossed": crossed, "mixed": mixed, "target": target, "items": items, "times": times, "a1": a1, "a2": a2, "weight": weight, "x": x, "u1": u1, "v1": v1, "u2": u2, "v2": v2}


def backward(p: Params, block: Block, kept: dict, d: np.ndarray) -> Params:
    """The gradient, given that of each row's logit."""
    g, n, row = {}, len(block.targets), block.row
    g["h3"], g["h3b"] = kept["v2"].T @ d, d.sum(keepdims=True)
    dv = d[:, None] * p["h3"]
    for layer, u, below in (("h2", kept["u2"], kept["v1"]), ("h1", kept["u1"], kept["crossed"][-1])):
        g[f"{layer}a"] = (dv * np.minimum(u, 0)).sum(keepdims=True).reshape(1)
        du = np.where(u > 0, dv, p[f"{layer}a"] * dv)
        g[layer], g[f"{layer}b"] = below.T @ du, du.sum(0)
        dv = du @ p[layer].T
    dx = np.zeros_like(dv)
    for k in reversed(range(len(kept["mixed"]))):
        dz, below = dv * kept["x"], kept["crossed"][k]
        dx += dv * kept["mixed"][k]
        dy = dz @ p[f"c{k}u"].T
        g[f"c{k}u"], g[f"c{k}b"], g[f"c{k}v"] = (below @ p[f"c{k}v"]).T @ dz, dz.sum(0), below.T @ dy
        dv = dv + dy @ p[f"c{k}v"].T
    dv = dv + dx
    if "w" in p:
        g["w"] = np.bincount(block.wide.ravel(), np.repeat(d, block.wide.shape[1]), len(p["w"]))
        g["wd"] = block.wide_dense.T @ d
    b, m = kept["target"].shape[1], block.scalars.shape[1] * p["table"].shape[1]
    dscalars, dtarget, dinterest = dv[:, :m], dv[:, m : m + b].copy(), dv[:, m + b : m + 2 * b]
    weight, items, target = kept["weight"], kept["items"], kept["target"]
    ditems = dinterest[row]
    dweight = np.einsum("ij,ij->i", items, ditems)
    ditems *= weight[:, None]
    ds = weight * (dweight - np.bincount(row, weight * dweight, n)[row]) / np.sqrt(max(b, 1))
    g["s3"], g["s3b"] = kept["a2"].T @ ds, ds.sum(keepdims=True)
    dz = ds[:, None] * p["s3"] * kept["a2"] * (1 - kept["a2"])
    g["s2"], g["s2b"] = kept["a1"].T @ dz, dz.sum(0)
    dz = (dz @ p["s2"].T) * kept["a1"] * (1 - kept["a1"])
    w1, w2, w3, w4 = np.split(p["s1"], 4)
    by_row = _by_row(dz, row, n)
    g1, g2 = target.T @ by_row, items.T @ dz
    g["s1"], g["s1b"] = np.concatenate([g1, g2, g1 - g2, kept["times"].T @ dz]), by_row.sum(0)
    d4 = dz @ w4.T
    ditems += dz @ (w2 - w3).T
    ditems += d4 * target[row]
    d4 *= items
    dtarget += by_row @ (w1 + w3).T + _by_row(d4, row, n)
    width = p["table"].shape[1]
    places = np.concatenate([block.scalars.ravel(), block.targets.ravel(), block.items.ravel()])
    rows = np.concatenate([x.reshape(-1, width) for x in (dscalars, dtarget, ditems)])
    g["table"] = np.stack([np.bincount(places, rows[:, k], len(p["table"])) for k in range(width)], 1)
    return g


def loss_and_gradient(p: Params, block: Block) -> tuple[float, Params]:
    """Sums over the block's rows of the log loss and its gradient."""
    logit, kept = forward(p, block)
    loss = np.logaddexp(0, logit) - block.label * logit
    return float(loss.sum()), backward(p, block, kept, _sigmoid(logit) - block.label)


# --- rows


def _place(name: str, value: Column, places: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit(""))), F.lit(places)).cast("int")


def prepare(df: DataFrame, inputs: Inputs, shape: Shape, moments: Mapping[str, tuple[float, float]]) -> DataFrame:
    """scalars, targets, items (all behaviours' places end to end), dense and label, and all columns of `df` as `held`. Moments
    are the mean and deviation of training rows."""
    names = list(inputs.targets)
    histories = [F.coalesce(F.col(h), F.array().cast(df.schema[h].dataType)) for h in inputs.targets.values()]
    length = F.least(*(F.size(h) for h in histories), *[F.lit((1 << 31) - 1)] * 2)
    number = lambda c: F.coalesce((F.col(c).cast("double") - F.lit(moments[c][0])) / F.lit(moments[c][1]), F.lit(0.0))
    ints, doubles = F.array().cast("array<int>"), F.array().cast("array<double>")
    return df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("held"),
        (F.array(*(_place(c, F.col(c), shape.places) for c in inputs.scalars)) if inputs.scalars else ints).alias("scalars"),
        (F.array(*(_place(c, F.col(c), shape.places) for c in names)) if names else ints).alias("targets"),
        (F.flatten(_interleaved(names, histories, length, shape.places)) if names else ints).alias("items"),
        (F.array(*(number(c) for c in inputs.dense)) if inputs.dense else doubles).alias("dense"),
        (F.array(*(_place(f"wide {c}", F.col(c), shape.places) for c in inputs.wide)) if inputs.wide else ints).alias("wide"),
        (F.array(*(number(c) for c in inputs.wide_dense)) if inputs.wide_dense else doubles).alias("wide_dense"),
        (F.col(inputs.label) if inputs.label in df.columns else F.lit(None)).cast("double").alias("label"),
    )


def _interleaved(names: Sequence[str], histories: Sequence[Column], length: Column, places: int) -> Column:
    """For each behaviour the list of its places. Other histories are looked up as they are: a list made of them would be made again for
    each behaviour."""
    others = list(zip(names, histories))[1:]
    return F.transform(F.slice(histories[0], F.lit(1), length), lambda x, i: F.array(_place(names[0], x, places), *(_place(c, F.get(h, i), places) for c, h in others)))


def _blocks(batches: Iterator[pa.RecordBatch], n_targets: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            n = batch.num_rows
            flat = lambda c, kind: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind)  # noqa: B023, E731
            sizes = pc.list_value_length(batch.column("items")).to_numpy(zero_copy_only=False).astype(np.int64) // max(n_targets, 1)
            label = batch.column("label").fill_null(0.0).to_numpy()
            yield batch, Block(flat("scalars", np.int64).reshape(n, -1), flat("targets", np.int64).reshape(n, -1), flat("items", np.int64), np.repeat(np.arange(n), sizes), flat("dense", float).reshape(n, -1), label, flat("wide", np.int64).reshape(n, -1), flat("wide_dense", float).reshape(n, -1))


def cross_layer(x0: Sequence[Column], x: Sequence[Column], v: Sequence[Sequence[float]], u: Sequence[Sequence[float]], b: Sequence[float]) -> list[Column]:
    """One low-rank cross layer over columns: x0 times (x v u + b), plus x."""
    total = lambda terms: sum(terms, F.lit(0.0))
    low = [total(c * F.lit(float(row[k])) for c, row in zip(x, v)) for k in range(len(u))]
    return [first * (total(c * F.lit(float(row[i])) for c, row in zip(low, u)) + F.lit(float(b[i]))) + own for i, (first, own) in enumerate(zip(x0, x))]


def _flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(like: Params, flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


_PARTS = ("scalars", "targets", "items", "dense", "wide", "wide_dense", "label")
_SUMS = "part int, n long, loss double, gradient binary"


def gradient(rows: DataFrame, p: Params, inputs: Inputs) -> tuple[int, float, Params]:
    """Rows, and the sums over them of loss and gradient. Each task sends one sum; `GROUP` of these are added up by one task, and
    their sums, as many as there are groups, reach the driver."""
    told = rows.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, loss, total = told.value, 0, 0.0, None
        for batch, block in _blocks(batches, len(inputs.targets)):
            more, g = loss_and_gradient(own, block)
            n, loss, total = n + batch.num_rows, loss + more, _flat(g) if total is None else total + _flat(g)
        if n:
            part = TaskContext.get().partitionId() // GROUP
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["part", "n", "loss", "gradient"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g, np.float64) for g in table.column("gradient").to_pylist())
        sums = [pa.array([x]) for x in (sum(table.column("n").to_pylist()), sum(table.column("loss").to_pylist()))]
        return pa.table([table.column("part").slice(0, 1).combine_chunks(), *sums, pa.array([total.tobytes()], pa.binary())], ["part", "n", "loss", "gradient"])

    sums = rows.select(*_PARTS).mapInArrow(run, _SUMS).groupBy("part").applyInArrow(add, _SUMS).collect()
    told.destroy()
    flat = sum((np.frombuffer(r["gradient"], np.float64) for r in sorted(sums, key=lambda r: r["part"])), np.zeros(sum(x.size for x in p.values())))
    return sum(r["n"] for r in sums), sum(r["loss"] for r in sums), _unflat(p, flat)


@dataclass
class Fitted:
    """A fitted model with the moments and names that its input needs; `losses` has the mean loss of each round."""

    params: Params
    inputs: Inputs
    shape: Shape
    moments: Mapping[str, tuple[float, float]]
    losses: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """The rows with the probability of a click."""
        told, names, n_targets = df.sparkSession.sparkContext.broadcast(self.params), [c for c in df.columns if c != out], len(self.inputs.targets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, block in _blocks(batches, n_targets):
                logit, _ = forward(told.value, block)
                yield pa.RecordBatch.from_arrays([batch.column("held"), pa.array(_sigmoid(logit))], ["held", "probability"])

        rows = prepare(df, self.inputs, self.shape, self.moments)
        found = rows.mapInArrow(run, StructType([rows.schema["held"], StructField("probability", DoubleType())]))
        return found.select(*(F.col("held").getField(c).alias(c) for c in names), F.col("probability").alias(out))


@dataclass
class Ready:
    """Rows to learn from, written once by shard for as many fits as are wanted, and what their preparation needs."""

    rows: DataFrame
    inputs: Inputs
    places: int
    shards: int
    moments: Mapping[str, tuple[float, float]]


def ready(train: DataFrame, inputs: Inputs, places: int = Shape.places, shards: int = 8) -> Ready:
    numbers = list(dict.fromkeys([*inputs.dense, *inputs.wide_dense]))
    told = fit_moments(train, numbers).first() if numbers else {}
    moments = {c: (told[f"{c}_mean"] or 0.0, told[f"{c}_std"] or 1.0) for c in numbers}
    rows = prepare(train.where(F.col(inputs.label).isNotNull()), inputs, Shape(places=places), moments)
    rows = written(rows.select(*_PARTS, F.pmod(F.xxhash64(*_PARTS), F.lit(shards)).cast("int").alias("shard")), "shard")
    return Ready(rows, inputs, places, shards, moments)


def fit(given: Ready, shape: Shape = Shape(), passes: int = 5, rate: float = 0.02, decay: float = 1e-5, seed: int = 0) -> Fitted:
    """Fits by `passes` times as many rounds as there are shards of Adam with a squared penalty of `decay`; each round reads one shard
    of the rows. The shape has the places of the rows."""
    if shape.places != given.places:
        raise ValueError(f"the rows have {given.places} places, the shape {shape.places}")
    p = shape.start(given.inputs, seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    out = Fitted(p, given.inputs, shape, given.moments)
    for step in range(1, passes * given.shards + 1):
        n, loss, g = gradient(given.rows.where(F.col("shard") == step % given.shards), p, given.inputs)
        if not n:
            continue
        out.losses.append(loss / n)
        for k in p:
            slope = g[k] / n + decay * p[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return out


def fit_interest(train: DataFrame, inputs: Inputs, shape: Shape = Shape(), passes: int = 5, shards: int = 8, rate: float = 0.02, decay: float = 1e-5, seed: int = 0) -> Fitted:
    """`fit` on its own inputs."""
    return fit(ready(train, inputs, shape.places, shards), shape, passes, rate, decay, seed)
