"""Operator 12 against all pairs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickspark.llm import hard_negatives, queries

_SCHEMA = "vec_id long, label int, vector array<double>"


def _clip(x):
    return max(min(x, hard_negatives._MOST_LONG), -hard_negatives._MOST_LONG)


def _brute(rows):
    """Rows of (id, label, whole numbers); anchors are those whose id is divisible by 100."""
    ok = [(i, x, v) for i, x, v in rows if x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, v in {(i, x, tuple(v)) for i, x, v in ok if i is not None and i % 100 == 0}:
        near = [(i, x, _clip(sum(int(p) * int(q) for p, q in zip(v, w)))) for i, x, w in ok if i != a]
        key = lambda r: (-r[2], r[0] is None, r[0] or 0)
        for p, _, s in sorted([r for r in near if r[1] == label], key=key)[: hard_negatives.POSITIVES]:
            fit = sorted([r for r in near if r[1] != label and 30 * s <= 100 * r[2] <= 90 * s], key=key)[: hard_negatives.NEGATIVES]
            out += [(a, p, k, n, s, t) for k, (n, _, t) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def _mined(spark, rows, parts=3):
    table = spark.createDataFrame([(i, x, None if v is None else list(map(lambda c: None if c is None else float(c), v))) for i, x, v in rows], _SCHEMA).repartition(parts)
    return sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect()), key=repr)


@pytest.mark.parametrize("part", [7, 64, 16_384])
def test_against_all_pairs(spark, monkeypatch, part):
    """Clusters, ties, repeated vectors, zero and long vectors, and parts of a few rows."""
    monkeypatch.setattr(hard_negatives, "PART_ROWS", part)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", max(1, part // 4))
    monkeypatch.setattr(hard_negatives, "STEP", 5)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (6, 8))
    rows = []
    for i in range(600):
        k = int(rng.integers(6))
        v = np.floor(centres[k] + rng.normal(0, 15, 8))
        rows.append((i, int(k % 4), list(v) if i % 9 else list(np.floor(centres[k]))))
    rows += [(700, 1, [0.0] * 8), (800, 2, [1.0] * 12), (801, 2, [3.0]), (802, 0, [2.0] * 3), (900, 3, []), (803, 1, [-c for c in rows[0][2]])]
    assert _mined(spark, rows) == _brute(rows)


def test_odd_rows(spark):
    """Nulls, components that are not finite, ids that are null or repeated, equal anchors, and numbers of any size."""
    big = 2.0**40
    rows = [
        (0, 1, [3, 4]), (0, 1, [3, 4]), (0, 2, [5, 1]), (1, 1, [4, 4]), (1, 1, [4, 4]), (None, 1, [9, 9]), (None, 2, [2, 2]), (2, 2, [3, 2]), (2, 2, [3, 2]), (3, None, [9, 9]), (4, 1, None), (5, 1, [9, None]),
        (6, 2, [9, math.inf]), (7, 2, [math.nan, 1]), (100, 3, [big, big]), (101, 3, [big, big + 4096]), (102, 4, [big / 2, big / 2 + 1]), (103, 4, [big / 2, 0.0]), (200, 5, [-1, -1]), (201, 5, [1, 1]), (300, 6, [1, 1]),
    ]
    assert _mined(spark, rows) == _brute(rows)
    assert _mined(spark, []) == []


@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([1.0, 1e3, 1e9, 1e150, 1e300]))
@settings(max_examples=150, deadline=None)
def test_bounds_hold(seed, dimension, size):
    """Every exact score lies within its bounds, for rows and for cells."""
    rng = np.random.default_rng(seed)
    rows, anchors = np.floor(rng.normal(0, size, (40, dimension))), np.floor(rng.normal(0, size, (5, dimension)))
    rows[:5] = anchors
    rows[5:8] = -2 * anchors[:3]
    told = rng.normal(0, 1, (4, dimension))
    told /= np.sqrt((told * told).sum(1))[:, None]
    norms, own = hard_negatives.angles(rows, told)
    for a, norm, of in zip(anchors, *hard_negatives.angles(anchors, told)):
        low, high = hard_negatives.bounds(norms, own, norm, of)
        exact = [sum(int(x) * int(y) for x, y in zip(row, a)) for row in rows]
        assert all(lo <= s <= hi for lo, s, hi in zip(low.tolist(), exact, high.tolist()))
        low, high = hard_negatives.bounds(norms.max(keepdims=True), own.min(0)[None], norm, of, own.max(0)[None])
        assert float(low[0]) <= min(exact) and max(exact) <= float(high[0])


def test_far_rows_are_not_scored(spark, monkeypatch):
    """In clustered data the bounds leave most rows unscored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (8, 16))
    vectors = np.floor(np.concatenate([c + rng.normal(0, 4, (200, 16)) for c in centres]))
    told = centres / np.sqrt((centres * centres).sum(1))[:, None]

    class Side:
        pass

    side = Side()
    side.ids, side.no_id, side.labels, side.vectors = np.arange(1600), np.zeros(1600, bool), np.repeat(np.arange(8), 200), vectors
    side.norms, side.angles = hard_negatives.angles(vectors, told)
    seen = []
    exact = hard_negatives.scores
    monkeypatch.setattr(hard_negatives, "scores", lambda rows, anchor: seen.append(len(rows)) or exact(rows, anchor))
    monkeypatch.setattr(hard_negatives, "STEP", 32)
    found = hard_negatives._search(side, np.arange(1600) > 0, side, 0, [(-(1 << 62), 1 << 62)], 5)[0]
    s = vectors @ vectors[0]
    s[0] = -np.inf
    assert sorted(found[1].tolist()) == sorted(np.sort(s)[-5:].astype(int).tolist())
    assert sum(seen) < 400


def test_query(spark, small):
    rows = []
    for r in spark.read.parquet(f"{small}/embeddings.parquet").collect():
        label = r["label"]
        if label is not None and r["vec_id"] % 7 == 0:
            label = (label + 1) % 10
        rows.append((r["vec_id"], label, None if r["embedding"] is None else [None if x is None else math.floor(256 * float(x)) for x in r["embedding"]]))
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, small).collect()), key=repr) == _brute(rows)
