"""Hard negatives of anchors by angular triangle filtering and exact integer scores.

Every row stores its norm and its angles to a few reference directions. By the triangle inequality of angles, the angle of
an anchor and a row lies between the difference and the sum of their angles to each reference; the cosines of these ends,
multiplied by both norms and rounded outwards, bound the pair's score. Only rows whose bounds overlap a window that is still
open are scored in integers. Rows of one nearest reference form a cell, and the cell's own ranges of angles and norms decide
which anchors meet it at all.

Anchors are a stated query set. They are dealt into blocks, rows into parts, and a block meets a part in one task, which
returns a bounded list for each anchor; lists are merged by rank. References come from a bounded sample and place rows only:
the result is exact whatever they are.

Edge cases: a row with a null label, a null vector, or a component that is null or not finite takes no part; vectors of
unequal length are compared as if the shorter ended in zeros; a zero vector scores 0 with every row; a row is never its own
partner, nor is another row of the same id; equal rows count each, but equal anchors are one anchor; rows without an id come
last among ties and are no anchors; scores beyond 64 bits stop at the ends of their range; an anchor without a positive, or
a positive without a negative in its window, returns nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that the reference directions are chosen from, and their number.
SAMPLE, REFERENCES = 4096, 24

#: Rows of a part, anchors of a block, rows scored before limits are looked at again, and groups that labels are dealt into.
PART_ROWS, ANCHOR_BLOCK, STEP, LABEL_GROUPS = 16_384, 4096, 512, 1024

#: Positives of an anchor, negatives of a positive, and the window's ends in hundredths of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90

#: What rounding may take from a cosine: angles are stored in 32 bits, and an arc cosine near 1 is good to 2e-8.
SLACK = 2e-6

_MOST_LONG, _NO_ID = (1 << 63) - 1, np.iinfo(np.int64).max
_STORED = "vec_id long, label long, vector binary, anchor boolean, norm double, angles array<float>, cell int"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of whole numbers, sent as 64-bit floats, as rows of a table; shorter ones end in zeros."""
    rows = [np.frombuffer(v, np.float64) for v in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for at, row in zip(out, rows):
        at[: len(row)] = row
    return out


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = min(a.shape[-1], b.shape[-1])
    return a[..., :d], b[..., :d]


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products: in 64-bit floats where every sum stays below 2^53, else in whole numbers of any size."""
    rows, anchor = _common(rows, anchor)
    if float(np.abs(anchor).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(len(anchor), 1) < 1 << 53:
        return (rows @ anchor).astype(np.int64)
    own = [int(x) for x in anchor]
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, own)), -_MOST_LONG), _MOST_LONG) for row in rows], np.int64)


def angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the angle of each vector to each reference of length 1. A zero vector has angle 0, and its norm bounds it."""
    most = np.abs(vectors).max(1, initial=0)
    scaled = vectors / np.where(most > 0, most, 1)[:, None]
    size = np.sqrt((scaled * scaled).sum(1))
    a, b = _common(scaled, references)
    cosines = np.where(size[:, None] > 0, a @ b.T / np.where(size > 0, size, 1)[:, None], 1.0)
    with np.errstate(over="ignore"):
        return size * most, np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def bounds(norms: np.ndarray, own: np.ndarray, norm: float, of: np.ndarray, upto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of rows with these norms and angles and an anchor. With `upto`, angles lie between `own` and
    `upto`, and norms are the greatest, as for cells."""
    upto = own if upto is None else upto
    apart = np.maximum(np.maximum(own - of, of - upto), 0).max(1, initial=0)
    near, far = own + of, upto + of
    widest = np.where(far < np.pi, far, np.where(near > np.pi, 2 * np.pi - near, np.pi)).min(1, initial=np.pi)
    high, low = np.cos(apart) + SLACK, np.cos(np.clip(widest, 0, np.pi)) - SLACK
    with np.errstate(over="ignore", invalid="ignore"):
        size = norms * norm
        if upto is not own:  # a shorter vector's score is nearer to 0
            high, low = np.maximum(high, 0), np.minimum(low, 0)
        least, greatest = np.floor(size * low) - 1, np.ceil(size * high) + 1
    sure = np.isfinite(size)
    return np.where(sure, least, -np.inf), np.where(sure, greatest, np.inf)


def references(items: DataFrame) -> np.ndarray:
    """Directions far from each other, picked one after the other from `SAMPLE` rows chosen by hash; each is the row whose angle
    to the nearest one before is largest. At most `SAMPLE` vectors reach the driver."""
    rows = [r[0] for r in items.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).select("vector").collect()]
    sample = np.zeros((len(rows), max(map(len, rows), default=0)))
    for at, row in zip(sample, rows):
        at[: len(row)] = row
    most = np.abs(sample).max(1, initial=0)
    sample = sample[most > 0] / most[most > 0][:, None]
    sample /= np.sqrt((sample * sample).sum(1))[:, None]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    chosen = [int(np.argmax(np.abs(sample @ sample.mean(0))))]
    nearest = sample @ sample[chosen[0]]
    while len(chosen) < min(REFERENCES, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def _stored(items: DataFrame, told: np.ndarray) -> DataFrame:
    """Rows with norm, angles and the cell of the nearest reference, kept in the checkpoint folder, with a number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, np.float64) for v in batch.column("vector").to_pylist()]
            raw = pa.array([v.tobytes() for v in vectors], pa.binary())
            norms, own = angles(_matrix(raw), told)
            cell = own.argmin(1) if own.shape[1] else np.zeros(len(own), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel()))
            columns = [batch.column("vec_id"), batch.column("label"), raw, batch.column("anchor"), pa.array(norms), listed, pa.array(cell, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "anchor", "norm", "angles", "cell"])

    return cut(items.mapInArrow(run, _STORED).withColumn("row", F.monotonically_increasing_id()))


class _Rows:
    """One side of a meeting, as arrays; rows without an id come last among ties."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("vec_id").fill_null(_NO_ID).to_numpy()
        self.no_id = table.column("vec_id").is_null().to_numpy()
        self.rows = table.column("row").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.vectors = _matrix(table.column("vector"))
        self.norms = table.column("norm").to_numpy()
        told = table.column("angles").combine_chunks()
        self.angles = told.flatten().to_numpy().reshape(len(told), -1) if len(told) else np.zeros((0, 0), np.float32)


def _best(s: np.ndarray, ids: np.ndarray, no_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by score, then id."""
    if len(s) > 4 * n:
        least = np.partition(s, len(s) - n)[len(s) - n]
        few = np.flatnonzero(s >= least)
        return few[_best(s[few], ids[few], no_id[few], n)] if len(few) < len(s) else np.lexsort((ids, no_id, -s))[:n]
    return np.lexsort((ids, no_id, -s))[:n]


def _search(rows: _Rows, allowed: np.ndarray, anchors: _Rows, k: int, windows: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores the first n allowed rows within it, as places and scores. Rows are taken by upper bound, highest
    first, until no window can gain from the next."""
    at = np.flatnonzero(allowed)
    low, high = bounds(rows.norms[at], rows.angles[at], float(anchors.norms[k]), anchors.angles[k])
    most = max((w[1] for w in windows), default=-1)
    least = min((w[0] for w in windows), default=0)
    near = (high >= least) & (low <= most)
    at, high = at[near], high[near]
    order = np.argsort(-high, kind="stable")
    at, high = at[order], high[order]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    floors = [w[0] for w in windows]
    done = 0
    while done < len(at) and high[done] >= min(floors, default=np.inf):
        step = at[done : done + STEP]
        done += len(step)
        s = scores(rows.vectors[step], anchors.vectors[k])
        for i, (lo, hi) in enumerate(windows):
            ok = (s >= floors[i]) & (s <= hi)
            if ok.any():
                places, told = np.concatenate([found[i][0], step[ok]]), np.concatenate([found[i][1], s[ok]])
                keep = _best(told, rows.ids[places], rows.no_id[places], n)
                found[i] = places[keep], told[keep]
                if len(keep) == n:
                    floors[i] = max(lo, int(told[keep].min()))
    return found


_PAIRS = "anchor long, anchor_id long, row long, partner_id long, score long"


def _pairs(out: list[tuple], of: _Rows) -> pa.Table:
    """(anchor number, anchor id, positive number or None, places, scores) as a table."""
    places = np.concatenate([o[-2] for o in out]) if out else np.zeros(0, np.int64)
    sizes = [len(o[-2]) for o in out]
    columns = {name: pa.array(np.repeat(np.array([o[i] for o in out], np.int64), sizes)) for i, name in enumerate(("anchor", "anchor_id", "positive")[: len(out[0]) - 2 if out else 2])}
    columns |= {"row": pa.array(of.rows[places]), "partner_id": pa.array(of.ids[places], mask=of.no_id[places]), "score": pa.array(np.concatenate([o[-1] for o in out]) if out else np.zeros(0, np.int64))}
    return pa.table(columns)


def _positives(left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    if left.num_rows and right.num_rows:
        rows, anchors = _Rows(left), _Rows(right)
        for k in range(len(anchors.ids)):
            allowed = (rows.labels == anchors.labels[k]) & ((rows.ids != anchors.ids[k]) | rows.no_id)
            for places, s in _search(rows, allowed, anchors, k, [(-_MOST_LONG, _MOST_LONG)], POSITIVES):
                out.append((anchors.rows[k], anchors.ids[k], places, s))
    return _pairs(out, _Rows(left)) if out else pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "anchor_id", "row", "partner_id", "score")})


def window(score: int) -> tuple[int, int]:
    """The least and the greatest score of a negative beside a positive of this score; empty if the first is above the second."""
    return -((-LEAST * score) // 100), (MOST * score) // 100


def _negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    if left.num_rows and right.num_rows:
        rows, anchors = _Rows(left), _Rows(right)
        given = right.column("positives").to_pylist()
        for k, positives in enumerate(given):
            allowed = (rows.labels != anchors.labels[k]) & ((rows.ids != anchors.ids[k]) | rows.no_id)
            told = [(p["row"], window(p["score"])) for p in positives]
            told = [(p, w) for p, w in told if w[0] <= w[1]]
            for (p, _), (places, s) in zip(told, _search(rows, allowed, anchors, k, [w for _, w in told], NEGATIVES)):
                out.append((anchors.rows[k], anchors.ids[k], p, places, s))
    return _pairs(out, _Rows(left)) if out else pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "anchor_id", "positive", "row", "partner_id", "score")})


def _meet(rows: DataFrame, anchors: DataFrame, sizes: DataFrame, find, schema: str) -> DataFrame:
    """Each part of a group's rows with each block of the group's anchors; sizes (group, parts, blocks) has a bounded number of
    groups. Parts and blocks hold a bounded number of rows."""
    sizes = F.broadcast(sizes)
    left = rows.join(sizes, "group").withColumn("part", F.pmod("row", "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = anchors.join(sizes, "group").withColumn("block", F.pmod("row", "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = [F.col(c).cast("long").alias(c) for c in ("group", "part", "block")]
    sent = [c for c in ("vec_id", "row", "label", "vector", "norm", "angles", "positives")]
    left, right = (side.select(*key, *[F.col(c).alias(c) for c in sent if c in side.columns]) for side in (left, right))
    return left.groupBy("group", "part", "block").cogroup(right.groupBy("group", "part", "block")).applyInArrow(find, schema)


def _first(pairs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n of each key, as `rank`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("partner_id"), "row")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _routes(anchors: DataFrame, cells: DataFrame) -> DataFrame:
    """Anchors once for each cell that may hold a row of one of their windows. `cells` has at most `REFERENCES` rows, which are
    looked at on the driver."""
    told = cells.collect()
    group = np.array([c["group"] for c in told], np.int64)
    norms = np.array([c["norm"] for c in told], np.float64)
    least, most = (np.array([c[x] for c in told], np.float32).reshape(len(told), len(told[0][x]) if told else 0) for x in ("least", "most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick, where = [], [np.zeros(0, np.int64)]
            for i, (norm, own, positives) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("norm", "angles", "positives")))):
                windows = [w for w in (window(p["score"]) for p in positives) if w[0] <= w[1]]
                low, high = bounds(norms, least, norm, np.array(own, np.float32), most)
                hit = np.zeros(len(group), bool)
                for w in windows:
                    hit |= (low <= w[1]) & (high >= w[0])
                pick += [i] * int(hit.sum())
                where.append(group[hit])
            taken = batch.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(where))], [*batch.schema.names, "group"])

    return anchors.mapInArrow(run, "row long, vec_id long, label long, vector binary, norm double, angles array<float>, positives array<struct<row: long, id: long, score: long>>, group long")


def mine(items: DataFrame, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `items` has vec_id, label and vector, a list of
    whole numbers as doubles; `anchor` tells the query rows."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    items = items.select("vec_id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("anchor"))
    items = items.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False)))
    told = references(items)
    rows = _stored(items, told)
    anchors = rows.where("anchor").groupBy("vec_id", "label", "vector").agg(F.min("row").alias("row"), F.first("norm").alias("norm"), F.first("angles").alias("angles"))

    by_label = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("long")
    sizes = rows.groupBy(by_label.alias("group")).agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"), F.ceil(F.sum(F.col("anchor").cast("long")) / ANCHOR_BLOCK).alias("blocks")).where("blocks > 0")
    found = _first(_meet(rows.withColumn("group", by_label), anchors.withColumn("group", by_label), sizes, _positives, _PAIRS), ["anchor"], POSITIVES)
    positives = cut(found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("row"), F.col("partner_id").alias("id"), "score"))).alias("positives")))
    positives = positives.withColumn("positives", F.transform("positives", lambda p: F.struct(p["row"].alias("row"), p["id"].alias("id"), p["score"].alias("score"))))

    asked = anchors.join(positives, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "vector", "norm", "angles", "positives")
    blocks = F.ceil(F.lit(positives.count()) / ANCHOR_BLOCK)
    edges = [[f(F.get("angles", F.lit(j))) for j in range(len(told))] for f in (F.min, F.max)]
    cells = rows.groupBy(F.col("cell").cast("long").alias("group")).agg(
        F.ceil(F.count("*") / PART_ROWS).alias("parts"), F.greatest(blocks, F.lit(1)).alias("blocks"), F.max("norm").alias("norm"), F.array(*edges[0]).cast("array<float>").alias("least"), F.array(*edges[1]).cast("array<float>").alias("most"),
    )
    routed = _routes(asked, cells.select("group", "norm", "least", "most"))
    near = _meet(rows.withColumn("group", F.col("cell").cast("long")), routed, cells.select("group", "parts", "blocks"), _negatives, _PAIRS.replace("row long", "positive long, row long"))
    ranked = _first(near, ["anchor", "positive"], NEGATIVES).withColumnsRenamed({"partner_id": "negative_id", "score": "negative_score"}).drop("row")
    of = positives.select("anchor", F.explode("positives").alias("_p")).select("anchor", F.col("_p.row").alias("positive"), F.col("_p.id").alias("positive_id"), F.col("_p.score").alias("positive_score"))
    return ranked.join(of, ["anchor", "positive"]).select("anchor_id", "positive_id", F.col("rank").cast("long").alias("rank"), "negative_id", "positive_score", "negative_score")
