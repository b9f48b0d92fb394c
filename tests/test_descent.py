"""Fits by passes over blocks: gradients by differences, known minima, and results that do not depend on how rows are dealt."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clickspark.operators import descent, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 3001
    x, c = rng.normal(size=n), rng.choice(["a", "b", "c"], n)
    y = rng.random(n) < 1 / (1 + np.exp(-(-1 + 2 * x - 1.5 * (c == "b"))))
    return spark.createDataFrame([(float(a), str(b), int(k)) for a, b, k in zip(x, c, y)], "x double, c string, clk int").cache()


def test_perceptron_gradient():
    rng = np.random.default_rng(1)
    layers, x, y = [4, 3, 2, 2], rng.normal(size=(7, 4)), rng.integers(0, 2, 7).astype(float)
    w = rng.normal(size=4 * 3 + 3 + 3 * 2 + 2 + 2 * 2 + 2)
    told = descent.perceptron_sums(w, layers, x, np.arange(4), y)
    assert told[0] == 7
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        slope = (descent.perceptron_sums(w + e, layers, x, np.arange(4), y)[1] - descent.perceptron_sums(w - e, layers, x, np.arange(4), y)[1]) / 2e-6
        assert told[2 + i] == pytest.approx(slope, abs=1e-6)


def test_steps_reach_a_curved_valley():
    def f(p):
        a, b = p
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert descent.lbfgs(f, np.array([-1.2, 1.0]), 100, 1e-12) == pytest.approx([1, 1], abs=1e-5)


def test_every_row_weighs_the_same_in_a_perceptron(rows, monkeypatch):
    """The same weights whatever the tasks and groups, although most tasks' rows fill no whole block; the first loss is that of Spark's weights."""
    monkeypatch.setattr(descent, "GROUP", 3)
    given = models.ready(rows, ["c"], ["x"], hash_size=16)
    few, many = (models.deep(models.Ready(given.inputs, given.texts, given.dense, part, "clk"), (5,), max_iter=6).model.stages[-1].weights.toArray() for part in (given.rows.coalesce(1), given.rows.orderBy("clk", F.xxhash64("features")).repartition(7)))
    assert few == pytest.approx(many, abs=1e-7)


def test_perceptron_scores_as_its_loss_says(rows):
    """Spark scores rows by the weights as the passes lay them out, from vectors stored in full or by place."""
    spark = rows.sparkSession
    told = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0, 0.5])), (0, Vectors.sparse(3, [1], [3.0])), (1, Vectors.sparse(3, [], []))], ["clk", "features"])
    given = models.Ready(models.PipelineModel(stages=[]), [], [], told, "clk")
    fitted = models.deep(given, (4,), max_iter=3)
    w, layers = fitted.model.stages[-1].weights.toArray(), [3, 4, 2]
    loss = descent.passed(descent.packed(told, "clk"), lambda x, used, y: descent.perceptron_sums(w, layers, x, used, y))[1]
    found = models.score(fitted, told).collect()
    assert loss == pytest.approx(-sum(np.log(r["score"] if r["clk"] else 1 - r["score"]) for r in found))

