"""The model with learned attention: numeric gradients, odd rows, and planted data that a fixed score cannot tell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickspark.operators import attention, interest, metrics, models

INPUTS = interest.Inputs(["user", "pid"], {"cate": "cates", "brand": "brands"}, ["price"])
SMALL = interest.Shape(places=32, width=3, scorer=(5, 4), hidden=(6, 5))


def _block(rng, n=7):
    sizes = rng.integers(0, 5, n)
    sizes[2] = 0
    total = int(sizes.sum())
    return interest.Block(rng.integers(0, 32, (n, 2)), rng.integers(0, 32, (n, 2)), rng.integers(0, 32, 2 * total), np.repeat(np.arange(n), sizes), rng.normal(0, 1, (n, 1)), rng.integers(0, 2, n).astype(float), rng.integers(0, 32, (n, 2)), rng.normal(0, 1, (n, 1)))


@pytest.mark.parametrize("crossed", [False, True])
def test_gradients(crossed):
    rng = np.random.default_rng(0)
    shape = interest.Shape(places=32, width=3, scorer=(5, 4), hidden=(6, 5), cross=2, rank=4) if crossed else SMALL
    p = shape.start(interest.Inputs(["user", "pid"], {"cate": "cates", "brand": "brands"}, ["price"], wide=["a", "b"], wide_dense=["x"]) if crossed else INPUTS, 1)
    p = {k: v + rng.normal(0, 0.3, v.shape) for k, v in p.items()}
    block = _block(rng)
    _, g = interest.loss_and_gradient(p, block)
    assert set(g) == set(p) and (not crossed or {"w", "wd", "c1v"} <= set(p))
    for k in p:
        for at in rng.integers(0, p[k].size, 12):
            def moved(step, k=k, at=at):
                q = dict(p)
                q[k] = p[k].copy()
                q[k].ravel()[at] += step
                return interest.loss_and_gradient(q, block)[0]

            assert g[k].ravel()[at] == pytest.approx((moved(1e-5) - moved(-1e-5)) / 2e-5, abs=2e-5), k


def test_sums_do_not_depend_on_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(9)), "p0", int(rng.integers(5)), None, [int(x) for x in rng.integers(0, 5, i % 4)], [None] * (i % 4), float(i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "user long, pid string, cate long, brand long, cates array<long>, brands array<long>, price double, clk int")
    p = SMALL.start(INPUTS, 3)
    ready = interest.prepare(df, INPUTS, SMALL, {"price": (30.0, 10.0)})
    one, many = interest.gradient(ready.coalesce(1), p, INPUTS), interest.gradient(ready.repartition(9), p, INPUTS)
    assert one[0] == many[0] == 60 and one[1] == pytest.approx(many[1])
    assert all(np.allclose(one[2][k], many[2][k]) for k in p)


def _planted(spark, n=4000):
    """A click follows if the history holds the target's opposite, two categories further on; likeness says nothing."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        target, hist = int(rng.integers(4)), [int(x) for x in rng.integers(0, 4, 3)]
        clicked = rng.random() < (0.95 if (target + 2) % 4 in hist else 0.05)
        rows.append((i, int(rng.integers(50)), "p0", target, 1, hist, [1] * 3, float(rng.normal()), int(clicked)))
    return spark.createDataFrame(rows, "id long, user long, pid string, cate long, brand long, cates array<long>, brands array<long>, price double, clk int").repartition(4)


def test_planted_interest(spark):
    df = _planted(spark)
    train, valid = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    shape = interest.Shape(places=512, width=6, scorer=(16, 8), hidden=(24, 12))
    model = interest.fit_interest(train, INPUTS, shape, passes=25, shards=2, rate=0.03)
    assert model.losses[-1] < 0.8 * model.losses[0]
    learned = metrics.auc(model.score(valid)).first()[0]
    # the fixed score: dot products of vectors learned from the lists alone, their weighted sum, and a linear model
    vectors = attention.item_embeddings(train.withColumn("seq", F.concat("cates", F.array("cate"))), "seq", size=6)
    pooled = attention.interest_features(df, vectors, "id", "cate", "cates", {"cate": ("cate", "cates")})
    flat = pooled.withColumns({f"i{k}": F.get("interest", F.lit(k)) for k in range(6)})
    plain = models.fit_lr(flat.where("id % 4 <> 0"), ["cate"], [f"i{k}" for k in range(6)])
    fixed = metrics.auc(models.score(plain, flat.where("id % 4 = 0"))).first()[0]
    assert learned > 0.9 and learned > fixed + 0.1


def test_planted_three_way_cross(spark):
    """A click follows the parity of three values: no pair of them says anything."""
    rng = np.random.default_rng(4)
    rows = [(i, *(int(x) for x in v), int(rng.random() < (0.95 if v.sum() % 2 else 0.05))) for i, v in enumerate(rng.integers(0, 2, (3000, 3)))]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, clk int").repartition(4)
    train, valid = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    model = interest.fit_interest(train, interest.Inputs(["a", "b", "c"], {}, []), interest.Shape(places=64, width=4, hidden=(16, 8), cross=2, rank=4), passes=25, shards=2, rate=0.03)
    pairs = models.fit_cross(train, ["a", "b", "c"], [], rank=4)
    assert metrics.auc(model.score(valid)).first()[0] > 0.9 > 0.6 > metrics.auc(pairs.score(valid)).first()[0]


def test_wide_and_deep_together(spark):
    """One value is known by the wide part alone, another by the deep part alone; together they tell both."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        w, d, x = int(rng.integers(8)), int(rng.integers(8)), float(rng.normal())
        logit = 2.5 * (w % 2) + 2.5 * (d % 2) - 2.5 + x
        rows.append((i, w, d, x, int(rng.random() < 1 / (1 + np.exp(-logit))), float(logit)))
    df = spark.createDataFrame(rows, "id long, w int, d int, x double, clk int, truth double").repartition(4)
    train, valid = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    shape = interest.Shape(places=4096, width=4, hidden=(8, 4))  # so many places that no two values meet
    score = lambda inputs: metrics.auc(interest.fit_interest(train, inputs, shape, passes=15, shards=2, rate=0.05).score(valid)).first()[0]
    both = score(interest.Inputs(["d"], {}, [], wide=["w"], wide_dense=["x"]))
    assert both > metrics.auc(valid, "truth").first()[0] - 0.03 and both > score(interest.Inputs(["d"], {}, [])) + 0.1


def test_the_scorer_in_spark(spark):
    """The learned score as a column function equals the one in arrays."""
    p = SMALL.start(interest.Inputs([], {"cate": "cates"}, []), 5)
    rng = np.random.default_rng(1)
    t, v = rng.normal(0, 1, (6, 3)), rng.normal(0, 1, (6, 3))
    four = np.concatenate([t, v, t - v, t * v], 1)
    expected = (interest._sigmoid(interest._sigmoid(four @ p["s1"] + p["s1b"]) @ p["s2"] + p["s2b"]) @ p["s3"] + p["s3b"]) / np.sqrt(3)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(t, v))], "id int, t array<double>, v array<double>")
    found = [r[0] for r in df.orderBy("id").select(attention.learned_score(p)(F.col("t"), F.col("v"))).collect()]
    assert found == pytest.approx(expected.tolist())


def test_odd_rows(spark):
    schema = "user long, pid string, cate long, brand long, cates array<long>, brands array<long>, price double, clk int, held string"
    rows = [(None, None, None, None, None, None, None, None, "a"), (1, "p", 2, 3, [], [], 1.0, 1, None), (1, "p", 2, 3, [2, None], [3], 2.0, 0, "b"), (2, "q", 9, 9, [1, 2, 3], [4, 5, 6], None, 1, "c")]
    df = spark.createDataFrame(rows, schema)
    model = interest.fit_interest(df, INPUTS, SMALL, passes=2, shards=2)
    found = model.score(df)
    assert found.columns == [*df.columns, "score"] and sorted(r["held"] or "" for r in found.collect()) == ["", "a", "b", "c"]
    assert all(0 < r["score"] < 1 for r in found.collect())
    assert interest.fit_interest(df.where("false"), INPUTS, SMALL).losses == []
    assert model.score(df.where("false").drop("clk")).collect() == []


def test_behaviours_share_the_places_of_targets(spark):
    """A value has one place for its field, wherever it stands in a history; histories are taken apart once, whatever their length."""
    told = [(5, 9, [5, 5, 6, 5], [9, 6, 9, None]), (None, 6, [None, 5], [6]), (6, None, [], [9]), (5, 5, None, [9])]
    df = spark.createDataFrame(told, "cate long, brand long, cates array<long>, brands array<long>")
    rows = interest.prepare(df, interest.Inputs([], {"cate": "cates", "brand": "brands"}, []), interest.Shape(places=1 << 20), {})
    place = {}
    found = rows.select("held", "targets", "items").collect()
    for r in found:
        place |= {("cate", r["held"]["cate"]): r["targets"][0], ("brand", r["held"]["brand"]): r["targets"][1]}
    assert len(set(place.values())) == len(place) == 7
    for r in found:
        pairs = zip(r["held"]["cates"] or [], r["held"]["brands"])
        assert r["items"] == [place[at] for c, b in pairs for at in (("cate", c), ("brand", b))]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


def test_fits_share_prepared_rows(spark, monkeypatch):
    """Two shapes are fitted on rows written once, and each as on rows of its own; places must agree."""
    df = _planted(spark, 300)
    shapes = [SMALL, interest.Shape(places=32, width=3, scorer=(7, 4), hidden=(6, 5))]
    own = [interest.fit_interest(df, INPUTS, shape, passes=1, shards=2) for shape in shapes]
    wrote, write = [], interest.written
    monkeypatch.setattr(interest, "written", lambda rows, *by: wrote.append(by) or write(rows, *by))
    given = interest.ready(df, INPUTS, 32, shards=2)
    for one, shape in zip(own, shapes):
        shared = interest.fit(given, shape, passes=1)
        assert shared.losses == pytest.approx(one.losses) and all(np.allclose(shared.params[k], one.params[k]) for k in one.params)
    assert wrote == [("shard",)]
    with pytest.raises(ValueError, match="places"):
        interest.fit(given, interest.Shape())
