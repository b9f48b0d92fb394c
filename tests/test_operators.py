"""Hand-made cases with known answers, equivalences, leak checks, and planted models."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickspark import functions as fn
from clickspark.operators import attention, clean, encode, heavy, history, lookup, metrics, models, profile, sequences, split
from clickspark.plans import fixtures, queries, samples

CASES = [(1, 10, 1, 7, 100, 1), (2, 20, 1, 8, None, 0), (3, 30, 2, 7, 100, 0), (4, 30, 1, 7, 100, 1), (5, 40, 1, 7, 100, 0), (6, 50, 2, 8, None, 1)]
AD = {1: (0, 0, 0.05), 2: (0, 0, 0.05), 3: (1, 1, 0.136364), 4: (2, 1, 0.125), 5: (3, 2, 0.192308), 6: (1, 0, 0.045455)}
USER = {1: (0, 0, 0.05), 2: (1, 1, 0.208333), 3: (0, 0, 0.05), 4: (2, 1, 0.178571), 5: (3, 2, 0.28125), 6: (1, 0, 0.041667)}
PAIR = {1: (0, 0, 0.05), 2: (None, 0, None), 3: (0, 0, 0.05), 4: (1, 1, 0.208333), 5: (2, 2, 0.321429), 6: (None, 0, None)}


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(r, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), u, a, c, k) for r, t, u, a, c, k in CASES]
    return spark.createDataFrame(rows, "rid long, ts timestamp_ntz, user long, ad long, cate long, clk int")


def _told(df, prefix):
    return {r["rid"]: (r[f"{prefix}_hist_imp"], r[f"{prefix}_hist_clk"], r[f"{prefix}_hist_ctr"] and round(r[f"{prefix}_hist_ctr"], 6)) for r in df.collect()}


@pytest.mark.parametrize("keys,expected,a,b", [(["ad"], AD, 0.5, 10.0), (["user"], USER, 0.25, 5.0), (["user", "cate"], PAIR, 0.25, 5.0)])
def test_counters(cases, keys, expected, a, b):
    day = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    assert _told(history.history(cases, keys, "h", ["ts", "rid"], a=a, b=b), "h") == expected
    assert _told(history.history_by_day(cases, keys, "h", ["ts", "rid"], F.to_date("ts"), a=a, b=b), "h") == expected
    assert _told(history.history_by_day(cases, keys, "h", ["ts", "rid"], day, a=a, b=b), "h") == expected
    half = F.floor(F.second("ts") / 20)
    assert _told(history.history_by_day(cases, keys, "h", ["ts", "rid"], half, a=a, b=b), "h") == expected


def test_strict_counters_ignore_ties(cases):
    strict = _told(history.history_strict(cases, ["ad"], "h", "ts", a=0.5, b=10.0), "h")
    assert strict == AD | {4: (1, 1, 0.136364)}


def test_strict_counters_by_day(cases):
    for day in (F.date_trunc("minute", F.col("ts").cast("timestamp")), F.floor(F.second("ts") / 20)):
        assert _told(history.history_strict(cases, ["ad"], "h", "ts", day, a=0.5, b=10.0), "h") == AD | {4: (1, 1, 0.136364)}


@pytest.mark.parametrize("strict", [False, True])
def test_heavy_keys_by_ranges(spark, strict):
    """Keys above a count are dealt into ranges of time: the same result as one window, with missing keys, times and ties."""
    rng = np.random.default_rng(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 41 == 0 else start + datetime.timedelta(minutes=int(rng.integers(0, 300 if i % 10 else 40_000))), None if i % 53 == 0 else 7 if i % 10 else i % 5, "x" if i % 3 else None, int(i % 5 == 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "rid long, ts timestamp_ntz, ad long, pid string, clk int").repartition(4)
    for keys in (["ad"], ["ad", "pid"]):
        plan = (lambda rows: history.history_strict(df, keys, "h", "ts", heavy_rows=rows)) if strict else (lambda rows: history.history(df, keys, "h", ["ts", "rid"], heavy_rows=rows))  # noqa: B023
        whole, dealt = _told(plan(10**6), "h"), _told(plan(50), "h")
        assert whole == dealt and len(dealt) == 1500
        assert dealt == _told(history.history_strict(df, keys, "h", "ts", F.to_date("ts")) if strict else history.history_by_day(df, keys, "h", ["ts", "rid"], F.to_date("ts")), "h")
        key = lambda r: (r[2],) if keys == ["ad"] else (r[2], r[3])  # noqa: B023, E731
        at = lambda r: (r[1] is not None, r[1] or start) if strict else (r[1] is not None, r[1] or start, r[0])
        for r in rows[::17]:
            before = [q[4] for q in rows if key(q) == key(r) and at(q) < at(r)]
            assert dealt[r[0]][:2] == ((None, 0) if None in key(r) else (len(before), sum(before)))


def test_a_hot_day_is_many_tasks(spark):
    """One key has nine tenths of one day's rows; its windows hold no more than a tenth of them each."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), 7 if i % 10 else i % 90, i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "rid long, ts timestamp_ntz, ad long, clk int").repartition(4)
    told = heavy.heavy(df, ["ad"], "ts", 500)
    sizes = [r["count"] for r in told.ranged(df).where("ad = 7").groupBy("_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 600 and sum(sizes) == 5400
    assert heavy.heavy(df, ["ad"], "ts").ends is None
    found = _told(history.history(df, ["ad"], "h", ["ts", "rid"], heavy_rows=500), "h")
    assert found[5999][:2] == (5399, sum(k for i, _, a, k in rows if a == 7 and i < 5999))


def test_heavy_users_in_logs(spark, monkeypatch):
    """As-of lists, prior counts and reach are the same whether users are dealt into ranges or not, and as plain code says."""
    rng = np.random.default_rng(8)
    at = lambda i: None if i % 37 == 0 else int(rng.integers(0, 200))
    log = [(i, None if i % 29 == 0 else 1 if i % 4 else i % 7, at(i), f"v{i}") for i in range(400)]
    expo = [(i, None if i % 11 == 0 else 1 if i % 3 else i % 7, at(i), "n", 5) for i in range(90)]
    logs = spark.createDataFrame(log, "event_id long, user_key long, ts long, item string").repartition(3)
    shown = spark.createDataFrame(expo, "event_id long, user_key long, ts long, _n string, _b long").repartition(3)
    seen = {e[0]: [x[3] for x in sorted((x for x in log if None not in (e[1], e[2], x[2]) and x[1] == e[1] and x[2] < e[2]), key=lambda x: (x[2], x[0]))] for e in expo}
    for rows in (10**6, 20):
        monkeypatch.setattr(heavy, "HEAVY_ROWS", rows)
        found = sequences.asof_history(shown, logs, ["item"], 4)
        assert found.columns == [*shown.columns, "hist", "seq_len"]
        assert {r["event_id"]: [x["item"] for x in r["hist"]] for r in found.collect()} == {i: x[-4:] for i, x in seen.items()}
        assert {r[0]: r[1] for r in sequences.prior_count(shown, logs).collect()} == {i: len(x) for i, x in seen.items()}
        assert sorted(r["item"] for r in sequences.in_reach(shown, logs, 4).collect()) == sorted({v for x in seen.values() for v in x[-4:]})
        assert sequences.in_reach(shown, logs, 4).columns == logs.columns


def test_exposures_without_a_user_meet_nowhere(spark):
    """They pass the windows and joins by: only the few with a user are placed."""
    log = spark.range(50).selectExpr("id as event_id", "cast(id % 3 as bigint) as user_key", "id as ts", "id as item")
    expo = spark.range(4000).selectExpr("id as event_id", "case when id % 40 = 0 then id % 3 end as user_key", "id as ts")
    assert sequences._sides(expo, log, "user_key", "ts", F.col("event_id"), None).count() == 150
    assert sequences.asof_history(expo, log, ["item"], 2).where("user_key is null and seq_len = 0").count() == 3900


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_an_exposure_twice_is_two_rows(spark):
    log = spark.createDataFrame(LOG, "event_id long, user_key long, ts long, item string")
    expo = spark.createDataFrame([(1, 1, 25)] * 3, "event_id long, user_key long, ts long")
    assert [[x["item"] for x in r["hist"]] for r in sequences.asof_history(expo, log, ["item"], 5).collect()] == [["a", "b", "c"]] * 3


def test_logs_are_encoded_without_taking_lists_apart(spark, small):
    df = queries.queries()["encode_sequence"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and _exchanges(df) < 30


def test_codes_take_few_exchanges(spark, small):
    assert _exchanges(queries.queries()["network_sample"](spark, small)) < 40


def test_codes_of_many_kinds_of_columns(spark):
    rows = [(1, "b", 2.5, True, datetime.date(2024, 1, 2)), (2, None, -1.0, False, None), (3, "a", None, None, datetime.date(2023, 1, 1)), (10, "b", 2.5, True, datetime.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id long, v string, x double, k boolean, d date").withColumns({"_v": F.lit(1), "_i": F.lit(2), "n": F.col("id") * 10})
    out = encode.dense_codes(df, ["v", "x", "k", "d", "n"]).orderBy("id").collect()
    assert [tuple(r[c] for c in ("v", "x", "k", "d", "n", "_v", "_i")) for r in out] == [(1, 1, 1, 1, 0, 1, 2), (-1, 0, 0, -1, 1, 1, 2), (0, -1, -1, 0, 2, 1, 2), (1, 1, 1, 1, 3, 1, 2)]


def test_reading_queries_do_not_meet(spark, small, medium):
    """Two scale factors asked for one after the other, then collected."""
    for name in ("read_exposures", "read_ads", "read_profiles"):
        one, two = (queries.queries()[name](spark, d) for d in (small, medium))
        assert one.count() < two.count()


@pytest.mark.parametrize("strict", [False, True])
def test_a_frequent_key_is_not_one_task(spark, strict):
    """One ad has half the rows and a third have none; every window has more than the key to deal rows by."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i // 3 * 2), 7 if i % 2 else None if i % 3 else i % 11, i % 5 == 0) for i in range(900)]
    df = spark.createDataFrame([(i, t, k, int(c)) for i, t, k, c in rows], "rid long, ts timestamp_ntz, ad long, clk int").repartition(4)
    day = F.to_date("ts")
    found = history.history_strict(df, ["ad"], "h", "ts", day) if strict else history.history_by_day(df, ["ad"], "h", ["ts", "rid"], day)
    told = {r["rid"]: (r["h_hist_imp"], r["h_hist_clk"]) for r in found.collect()}
    for i, t, k, _ in rows:
        before = [c for j, u, other, c in rows if other == k and (u < t or not strict and u == t and j < i)]
        assert told[i] == ((None, 0) if k is None else (len(before), sum(before)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) >= 2 and all("_day" in line for line in windows)


def test_later_rows_change_nothing(cases):
    early = cases.where("rid <= 4")
    whole = _told(history.history(cases, ["ad"], "h", ["ts", "rid"]), "h")
    assert _told(history.history(early, ["ad"], "h", ["ts", "rid"]), "h") == {r: whole[r] for r in (1, 2, 3, 4)}


LOG = [(1, 1, 10, "a"), (2, 1, 20, "b"), (3, 1, 20, "c"), (4, 1, 30, "d")]
ASKED = [(1, 5, []), (1, 10, []), (1, 11, ["a"]), (1, 20, ["a"]), (1, 30, ["b", "c"]), (1, 99, ["c", "d"]), (9, 99, [])]


def _long_apart(*args):
    return sequences.asof_history_simple(*args, longest=3)


@pytest.mark.parametrize("plan", [sequences.asof_history_simple, sequences.asof_history, _long_apart])
@pytest.mark.parametrize("n", [1, 2, 3, 220])
def test_asof_sequences(spark, plan, n):
    log = spark.createDataFrame(LOG, "event_id long, user_key long, ts long, item string")
    expo = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(ASKED)], "event_id long, user_key long, ts long")
    found = {r["event_id"]: ([x["item"] for x in r["hist"]], r["seq_len"]) for r in plan(expo, log, ["item"], n).collect()}
    for i, (u, t, two) in enumerate(ASKED):
        whole = [x for _, v, s, x in LOG if v == u and s < t]
        assert found[i] == (whole[-n:], len(whole[-n:]))
        if n == 2:
            assert found[i][0] == two


def test_rows_without_user_or_time(spark):
    log = spark.createDataFrame([(1, 1, 10, "a"), (2, None, 10, "b"), (3, 1, None, "c"), (4, None, None, "d")], "event_id long, user_key long, ts long, item string")
    expo = spark.createDataFrame([(1, 1, 20), (2, None, 20), (3, 1, None), (4, 7, 20)], "event_id long, user_key long, ts long")
    for plan in (sequences.asof_history_simple, sequences.asof_history, _long_apart):
        assert {r["event_id"]: [x["item"] for x in r["hist"]] for r in plan(expo, log, ["item"], 5).collect()} == {1: ["a"], 2: [], 3: [], 4: []}
    assert {r[0]: r[1] for r in sequences.prior_count(expo, log).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    for part in (None, F.floor(F.col("ts") / 15)):
        logs = sequences.collect_user_log(log, ["item"], n=2, part=part).collect()
        assert sorted((r["user_key"] or 0, [x["item"] for x in r["log"]]) for r in logs) == [(0, ["d", "b"]), (1, ["c", "a"])]


@pytest.mark.parametrize("width", [None, 15])
def test_logs_in_blocks(spark, width):
    part = width and F.floor(F.col("ts") / width)
    log = spark.createDataFrame([*LOG, (5, 2, 10, "e"), (6, 2, 5, None)], "event_id long, user_key long, ts long, item string")
    found = {(r["user_key"], r["block"]): [x["item"] for x in r["log"]] for r in sequences.collect_user_log(log, ["item"], n=3, part=part).collect()}
    assert found == {(1, 0): ["a", "b", "c"], (1, 1): ["d"], (2, 0): [None, "e"]}


def test_asof_plans_agree(spark, medium):
    expo, log = fixtures.exposures(spark, medium), fixtures.behaviors(spark, medium)
    tied, tied_log = (d.withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp"))) for d in (expo, log))
    for e, b in ((expo, log), (tied, tied_log)):
        one, two = (p(e, b, ["item"], 5).select("event_id", "hist", "seq_len") for p in (sequences.asof_history, sequences.asof_history_simple))
        assert one.exceptAll(two).count() == 0 and one.count() == two.count()


def test_prior_count_needs_no_order(spark):
    log = spark.createDataFrame([(3, 1, 30), (1, 1, 10), (2, 1, 20)], "event_id long, user_key long, ts long")
    expo = spark.createDataFrame([(1, 1, 20), (2, 1, 31), (3, 2, 5)], "event_id long, user_key long, ts long")
    assert {r[0]: r[1] for r in sequences.prior_count(expo, log).collect()} == {1: 1, 2: 3, 3: 0}


def test_local_time(spark):
    at = spark.createDataFrame([(1494000000,)], "s long").withColumn("ts", fn.epoch_to_ntz("s"))
    local, utc = clean.add_time_parts(at, "ts", fn.LOCAL_ZONE).first(), clean.add_time_parts(at, "ts").first()
    assert (str(local["date"]), local["hour"], local["weekday"]) == ("2017-05-06", 0, 5)
    assert (str(utc["date"]), utc["hour"], utc["weekday"]) == ("2017-05-05", 16, 4)


def test_codes_and_vocabularies(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id long, v string")
    assert [r["v"] for r in encode.dense_codes(rows, ["v"]).orderBy("id").collect()] == [1, -1, 0]
    vocabulary = encode.fit_vocab(spark.createDataFrame([("x",), ("y",), ("x",)], "v string"), "v")
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id long, v string")
    assert [r["o"] for r in lookup.vocab_lookup(asked, vocabulary, "v", "o").orderBy("id").collect()] == [2, 3, 1, 1]
    lists = spark.createDataFrame([(1, ["x", "z"]), (2, []), (3, None), (4, ["y", "x", "y"])], "id long, v array<string>")
    told = encode.pad_sequences(encode.encode_sequence(lists, vocabulary, "v", "id", "o"), "o", 4)
    assert [r["o"] for r in told.orderBy("id").collect()] == [[2, 1, 0, 0], [0] * 4, [0] * 4, [3, 2, 3, 0]]


def test_many_values_are_numbered_alike(spark):
    numbers = spark.range(0, 500, 3).select(F.col("id").alias("value"))
    assert [r["id"] for r in encode.numbered(numbers).orderBy("value").collect()] == list(range(167))
    texts = numbers.select(F.concat(F.lit("t"), F.col("value").cast("string")).alias("value"))
    assert [r["id"] for r in encode.numbered(texts, 2).orderBy("value").collect()] == list(range(2, 169))
    many = spark.range(20_000).select(F.concat(F.lit("1_"), F.col("id").cast("string")).alias("value"))
    assert [r["id"] for r in encode.numbered(many).orderBy("value").collect()] == list(range(20_000))


def test_ranges_are_even(spark):
    """Texts that begin alike are dealt evenly, so no window spans more than a small share of them."""
    many = spark.range(20_000).select(F.concat(F.lit("prefix_"), F.col("id").cast("string")).alias("value"))
    few = many.orderBy(F.xxhash64("value"), "value").limit(encode.RANGES * encode.LOOKED_AT).collect()
    bounds = sorted(r[0] for r in few)[encode.LOOKED_AT - 1 :: encode.LOOKED_AT]
    sizes = np.bincount(np.searchsorted(bounds, sorted(f"prefix_{i}" for i in range(20_000))))
    assert len(bounds) == encode.RANGES and sizes.max() < 3 * 20_000 / encode.RANGES


def test_one_hot(spark):
    model = encode.one_hot(spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "v string"), ["v"])
    found = [r[0].toArray().tolist() for r in model.transform(spark.createDataFrame([(1, "z"), (2, None), (3, "b")], "id int, v string")).orderBy("id").select("v_hot").collect()]
    assert found == [[0, 0, 0], [0, 0, 0], [0, 1, 0]]


def test_one_hot_of_many_columns(spark):
    train = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("a", 3, None)], "v string, n long, none string")
    fitted = encode.one_hot(train, ["v", "n", "none"])
    asked = spark.createDataFrame([(1, "b", 3, "x"), (2, None, 9, None)], "id int, v string, n long, none string").withColumns({"held": F.lit(7), "t0": F.lit(8), "i0": F.lit(9)})
    out = fitted.transform(asked).orderBy("id").collect()
    assert [[r[f"{c}_hot"].toArray().tolist() for c in ("v", "n", "none")] for r in out] == [[[0, 1], [0, 0, 1], [0]], [[0, 0], [0, 0, 0], [0]]]
    assert [(r["held"], r["t0"], r["i0"]) for r in out] == [(7, 8, 9)] * 2 and list(fitted.sizes) == [2, 3, 0]


def test_many_categories_stay_a_table(spark):
    """A model over 200,000 categories of one column: the driver learns their number alone."""
    rows = spark.range(200_000).selectExpr("concat('c', id) as c", "cast(id % 7 as double) as x", "cast(id % 2 as int) as clk").repartition(4)
    given = models.ready(rows, ["c"], ["x"])
    assert given.encoder.sizes == [200_000] and not any("StringIndexer" in type(s).__name__ for s in given.inputs.stages)
    fitted = models.lr(given, max_iter=3)
    assert fitted.model.stages[-1].numFeatures == 200_001 and fitted.score(rows.limit(5)).count() == 5


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    for values in (rng.normal(size=5001).tolist(), rng.integers(0, 5, 1000).astype(float).tolist(), [3.0], list(range(20_000))):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
        assert profile.quantiles(rows, "x", at, ranges=16).first()[0] == pytest.approx(np.quantile(values, at).tolist())
    assert profile.length_quantiles(rows.where("false"), "x").first()[0] is None


def test_quantiles_of_many_values(spark):
    """Two million distinct values in ranges: no buffer holds them all."""
    rows = spark.range(2_000_000).selectExpr("id * 3 as x")
    assert list(profile.length_quantiles(rows, "x").first()) == pytest.approx([3 * p * 1_999_999 for p in profile.QUANTILES])


def test_sketches_unite(spark):
    rows = spark.range(60_000).selectExpr("id % 20000 as u", "cast(id % 3 as int) as day", "if(id % 2 = 0, 'a', null) as v")
    told = profile.distinct_sketches(rows, ["u", "v"], F.col("day"))
    assert told.count() == 3
    one = profile.united_counts(told, ["u", "v"]).first()
    assert one["n_rows"] == 60_000 and abs(one["n_u"] - 20_000) < 0.05 * 20_000 and one["n_v"] == 1
    assert profile.united_counts(told.where("part = 9"), ["u"]).first()["n_u"] == 0
    assert tuple(profile.distinct_counts(rows, ["u", "v"]).first()) == (60_000, 20_000, 1)


def test_planted_groups_of_items(spark):
    """Items of one group stand together; their nearest vectors are of their group."""
    rng = np.random.default_rng(2)
    lists = [(i, [int(x) for x in 10 * (i % 4) + rng.integers(0, 8, 9)]) for i in range(400)]
    found = {int(r["id"]): np.array(r["vector"]) for r in attention.item_embeddings(spark.createDataFrame(lists, "id int, h array<long>"), "h", size=6).collect()}
    assert len(found) == 32
    unit = {k: v / np.linalg.norm(v) for k, v in found.items()}
    for k, v in unit.items():
        best = max((x for x in unit if x != k), key=lambda x: v @ unit[x])
        assert best // 10 == k // 10
    counted = {(r["a"], r["b"]): r["weight"] for r in attention.co_occurrences(spark.createDataFrame([([1, 2, 1, 3],)], "h array<long>"), "h", 2).collect()}
    assert counted == pytest.approx({("1", "2"): 2.0, ("2", "1"): 2.0, ("2", "3"): 0.5, ("3", "2"): 0.5, ("1", "3"): 1.0, ("3", "1"): 1.0})


def test_scaling(spark):
    for train, value, expected in (([2.0, 2.0, 2.0], 5.0, 3.0), ([1.0, 2.0, 3.0], 4.0, 2.0)):
        moments = encode.fit_moments(spark.createDataFrame([(x,) for x in train], "x double"), ["x"])
        assert encode.standardize(spark.createDataFrame([(value,)], "x double"), moments, ["x"]).first()[0] == expected


def test_quantiles(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 10)], "x int")
    assert [round(v, 6) for v in profile.length_quantiles(rows, "x").first()] == [3, 4, 7.6, 8.8, 9.76]


def test_metrics(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, clk int")
    assert metrics.auc(rows).first()[0] == 0.875
    assert round(metrics.logloss(spark.createDataFrame([(0.9, 1), (0.2, 0)], "score double, clk int")).first()[0], 6) == 0.164252
    assert metrics.auc(rows.where("clk = 1")).first()[0] is None


def test_auc_over_ranges(spark):
    rng = np.random.default_rng(5)
    s, y = rng.integers(0, 200, 3000) / 200.0, rng.integers(0, 2, 3000)
    rows = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score double, clk int")
    wins = (s[y == 1][:, None] > s[y == 0]).sum() + 0.5 * (s[y == 1][:, None] == s[y == 0]).sum()
    assert metrics.auc(rows, ranges=16).first()[0] == pytest.approx(wins / (y.sum() * (1 - y).sum()))


def test_splits(spark):
    rows = spark.createDataFrame([(f"d{i}",) for i in (1, 2, 3, 4)], "date string")
    dates = lambda df: sorted(r[0] for r in df.collect())
    assert [dates(p) for p in split.split_last_date(rows)] == [["d1", "d2", "d3"], ["d4"]]
    assert [dates(p) for p in split.split_three_way(rows)] == [["d1", "d2"], ["d3"], ["d4"]]


def test_missing_rates_and_coverage(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (None, None), (2, 7)], "k int, v int")
    assert [(r[0], r[1]) for r in profile.missing_rates(rows).collect()] == [("v", 0.5), ("k", 0.25)]
    right = spark.createDataFrame([(2,), (2,), (None,)], "k2 int")
    assert tuple(lookup.coverage(rows, right, "k", "k2").first()) == (0.5, 0.5)


def test_sample_is_repeatable(spark):
    rows = spark.range(1000)
    one, two = (sorted(r[0] for r in profile.sample_rows(d, "id", 50, seed=3).collect()) for d in (rows.repartition(7), rows.repartition(2)))
    assert one == two == sorted(sorted(range(1000), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())[:50])


def test_assemble_and_users(spark):
    rows = spark.createDataFrame([(1.0, 2, 7), (None, 4, None), (2.0, 0, 7)], "x double, k int, user_key long")
    made = encode.assemble(rows, ["x", "k"]).collect()
    assert made[0]["features"].toArray().tolist() == [1.0, 2.0] and math.isnan(made[1]["features"][0])
    assert [r[0] for r in profile.distinct_users(rows).collect()] == [7]


def test_attention_without_history(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    rows = spark.createDataFrame([(1, 1, [1, 2]), (2, 1, []), (3, 9, [1])], "key long, target long, h array<long>")
    found = {r["key"]: r["interest"] for r in attention.interest_features(rows, vectors, "key", "target", "h", {"t": ("target", "h")}).collect()}
    w = math.exp(1 / math.sqrt(2))
    assert found[1] == pytest.approx([w / (w + 1), 1 / (w + 1)]) and found[2] == found[3] == [0.0, 0.0]


def test_wide_keeps_rows(spark, medium):
    expo = fixtures.exposures(spark, medium)
    assert samples.wide(expo, fixtures.ads(spark, medium), fixtures.profiles(spark, medium)).count() == expo.count() == 3988


def test_samples(spark, small):
    parts = [f(spark, small) for f in (fixtures.exposures, fixtures.ads, fixtures.profiles)]
    n = parts[0].count()
    assert samples.lr_sample(*parts).where("brand is null").count() == 0
    assert samples.tabular_sample(*parts).count() == n and samples.network_sample(*parts).count() == n
    sequence = samples.sequence_sample(*parts, fixtures.behaviors(spark, small), n=5)
    assert sequence.count() == n and sequence.where("size(hist_cate_seq) <> seq_len or seq_len > 5").count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    """Rows to learn from and rows held out."""
    rng = np.random.default_rng(11)
    n = 6000
    x, c = rng.normal(size=n), rng.choice(["a", "b", "c"], n)
    y = rng.random(n) < 1 / (1 + np.exp(-(-1 + 2 * x - 1.5 * (c == "b"))))
    rows = spark.createDataFrame([(float(a), str(b), int(k), i) for i, (a, b, k) in enumerate(zip(x, c, y))], "x double, c string, clk int, i int").cache()
    return rows.where("i < 4000"), rows.where("i >= 4000")


def test_logistic_optimum(planted):
    """Coefficients equal those of Newton's method on the penalised loss."""
    train, valid = planted
    model = models.fit_lr(train, ["c"], ["x"])
    order, rows = [r["text"] for r in model.encoder.codes.orderBy("id").collect()], train.collect()
    x = np.array([r["x"] for r in rows])
    z = np.column_stack([*(np.array([r["c"] == k for r in rows], float) for k in order), (x - x.mean()) / x.std(ddof=1), np.ones(len(rows))])
    y, w, penalty = np.array([r["clk"] for r in rows], float), np.zeros(5), np.diag([1.0, 1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    last = model.model.stages[-1]
    assert [*last.coefficients.toArray(), last.intercept] == pytest.approx(w, abs=1e-4)
    assert metrics.auc(models.score(model, valid)).first()[0] > 0.75


@pytest.mark.parametrize("fit", [
    lambda t: models.fit_gbt(t, ["c"], ["x"], rounds=8), lambda t: models.fit_cross(t, ["c"], ["x"], rank=2, max_iter=40), lambda t: models.fit_cross(t, ["c"], ["x"], rank=2, max_iter=40, hash_size=32),
    lambda t: models.fit_wide(t, ["c"], ["x"], hash_size=64), lambda t: models.fit_deep(t, ["c"], ["x"], hidden=(8,), max_iter=40), lambda t: models.fit_deep(t, ["c"], ["x"], hidden=(8,), max_iter=40, hash_size=None),
])
def test_planted_models(planted, fit):
    train, valid = planted
    assert metrics.auc(models.score(fit(train), valid)).first()[0] > 0.72


def test_boosting_stops_early(planted):
    train, valid = planted
    model = models.fit_gbt(train.withColumn("held", F.col("i") % 5 == 0), ["c"], ["x"], rounds=60, leaves=32, rate=0.9, validation="held")
    assert len(model.model.stages[-1].trees) < 60 and metrics.auc(models.score(model, valid)).first()[0] > 0.7


def test_leaderboard(planted):
    train, valid = planted
    rows = models.leaderboard({"good": lambda: models.fit_lr(train, ["c"], ["x"]), "poor": lambda: models.fit_lr(train, ["c"], [])}, valid).collect()
    assert [r["model"] for r in rows] == ["good", "poor"] and rows[0]["auc"] > rows[1]["auc"]


def test_the_test_day_never_chooses(planted):
    """The choice stays whatever the test rows say, inputs are prepared once for a grid, and the test rows are scored once."""
    train, valid = planted
    one = models.ready(train, ["c"], ["x"])
    fits = {"weak": lambda: models.lr(one, c=1e-6), "strong": lambda: models.lr(one), "no_number": lambda: models.fit_lr(train, ["c"], [])}
    turned = valid.withColumn("clk", 1 - F.col("clk"))
    plain, odd = models.choose(fits, valid, valid), models.choose(fits, valid, turned)
    board = [tuple(r)[:3] for r in plain.board.collect()]
    assert plain.name == odd.name == board[0][0] and board == [tuple(r)[:3] for r in odd.board.collect()]
    (told,), (other,) = plain.test.collect(), odd.test.collect()
    assert told["auc"] == pytest.approx(board[0][1]) and other["auc"] == pytest.approx(1 - told["auc"]) and told["model"] == other["model"] == plain.name


def test_attention_adds_up_where_rows_are_and_is_shuffled_once(spark):
    """No item's vector is shuffled: the plan has one exchange by key, after the sums of rows that follow each other. Keys that repeat
    or are missing, items without a vector, and histories longer than a batch come out as by hand."""
    rng = np.random.default_rng(3)
    vecs = {i: rng.normal(size=4) for i in range(30)}
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vecs.items()], "id long, vector array<double>")
    told = [(1, 3, [1, 2, 99, None]), (1, 4, [5]), (2, 3, [7] * 30_000 + [8]), (3, 77, [1]), (4, 2, None), (5, 2, []), (None, 2, [1, 2]), (None, 2, [1])]
    rows = spark.createDataFrame(told, "key long, target long, h array<long>").repartition(3)
    out = attention.attention_pool(rows, vectors, "key", "target", "h")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_key") == 1 and "Window" not in plan
    found = sorted(((r["key"], r["interest"]) for r in out.collect()), key=lambda r: (r[0] is None, r[0]))
    assert [k for k, _ in found] == [1, 1, 2, 3, 4, 5, None, None] and all(found[i][1] is None for i in (3, 4, 5, 6, 7))
    for i, pairs in ((0, [(3, 1), (3, 2), (4, 5)]), (2, [(3, 7)] * 30_000 + [(3, 8)])):
        s = np.array([vecs[t] @ vecs[h] / 2 for t, h in pairs])
        w = np.exp(s - s.max())
        assert np.allclose(found[i][1], (w / w.sum()) @ np.array([vecs[h] for _, h in pairs]))
    assert found[0][1] == found[1][1]


def test_counters_look_for_heavy_keys_in_joined_rows(spark, small, monkeypatch):
    """The rows that models learn from are joined once: no count of keys joins them again."""
    plans = []
    monkeypatch.setattr(history, "heavy", lambda df, keys, *more: plans.append(df.select(*keys)._jdf.queryExecution().executedPlan().toString()) or heavy.heavy(df, keys, *more))
    queries._model_rows(spark, small)
    spark.catalog.clearCache()
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_growing_tables_are_not_sent(spark, small):
    """Ads, profiles and parts grow with the log, so they are merged in tasks, though here they lie far below Spark's threshold."""
    for df in (samples.wide(*queries._parts(spark, small)), fixtures.behaviors(spark, small)):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()  # the final one, once sizes are known
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_score_interest_joins_its_rows_once(spark, small, monkeypatch):
    """The history gets the joined rows as a written table, for whose heavy users only behaviours are joined again."""
    class Seen(Exception):
        pass

    def seen(exposures, *more):
        raise Seen(exposures._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(sequences, "asof_history", seen)
    with pytest.raises(Seen) as told:
        queries.score_interest(spark, small)
    assert "FileScan" in str(told.value) and "Join" not in str(told.value)
