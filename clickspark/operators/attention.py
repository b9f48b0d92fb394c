"""Interest features: history items scored against the target, softmax, weighted sum of their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import dot
from ..sources.shared import written
from .encode import numbered


def co_occurrences(sequences: DataFrame, column: str, window: int = 5) -> DataFrame:
    """a, b, weight: how often two different items (texts) stand at most `window` places apart in a list, each time weighted by one
    over the distance; both orders. Only pairs within the window arise, and they are added up where they do."""
    items = F.transform(column, lambda x: x.cast("string"))
    near = lambda x, i: F.transform(F.slice("_x", i + 2, F.lit(window)), lambda y, j: F.struct(x.alias("a"), y.alias("b"), (F.lit(1.0) / (j + 1)).alias("w")))
    pairs = sequences.select(items.alias("_x")).select(F.explode(F.flatten(F.transform("_x", near))).alias("p")).select("p.*").where("a <> b")
    both = pairs.select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("p")).select("p.*")
    return both.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def item_embeddings(sequences: DataFrame, column: str, size: int = 16, window: int = 5, rounds: int = 8, penalty: float = 0.1, emphasis: float = 4.0, seed: int = 0) -> DataFrame:
    """id (text) and vector of every item that stands beside another in some list.

    Items' co-occurrences are factored by alternating least squares: items that stand beside the same others get similar vectors.
    Items are numbered by range, and numbers, counts and vectors stay tables from end to end, however many items there are."""
    pairs = written(co_occurrences(sequences, column, window))
    told = written(numbered(pairs.select(F.col("a").alias("value")).distinct()).select("value", F.col("id").cast("int").alias("n")))
    coded = pairs.join(told.select(F.col("value").alias("a"), F.col("n").alias("i")), "a").join(told.select(F.col("value").alias("b"), F.col("n").alias("j")), "b").select("i", "j", F.log1p("weight").alias("weight"))
    factors = ALS(userCol="i", itemCol="j", ratingCol="weight", rank=size, maxIter=rounds, regParam=penalty, implicitPrefs=True, alpha=emphasis, seed=seed).fit(coded).userFactors
    return factors.join(told, F.col("id") == F.col("n")).select(F.col("value").alias("id"), F.col("features").cast("array<double>").alias("vector"))


def scaled_dot(target: Column, item: Column) -> Column:
    """The dot product, divided by the root of the dimension."""
    return dot(target, item) / F.sqrt(F.size(target).cast("double"))


def learned_score(weights: Mapping[str, Sequence]) -> Callable[[Column, Column], Column]:
    """A score by two hidden layers over target, item, difference and product, divided by the root of the dimension. Weights are
    s1, s2 (a row for each input, a column for each unit), s3 (a list), and the constants s1b, s2b, s3b. Vectors that lack
    numbers, or whose lengths differ from each other or from the weights, have no score."""
    w = {k: np.array(weights[k], float) for k in ("s1", "s1b", "s2", "s2b", "s3", "s3b")}
    size = len(w["s1"]) // 4

    @F.arrow_udf("double")
    def layers(target: pa.Array, item: pa.Array) -> pa.Array:
        ok = _whole(target, size) & _whole(item, size)
        t, h = (x.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for x in (target, item))
        with np.errstate(over="ignore", invalid="ignore"):
            deep = 1 / (1 + np.exp(-(np.concatenate([t, h, t - h, t * h], 1) @ w["s1"] + w["s1b"])))
            deep = 1 / (1 + np.exp(-(deep @ w["s2"] + w["s2b"])))
        out = np.zeros(len(ok))
        out[ok] = (deep @ w["s3"] + w["s3b"][0]) / size**0.5
        return pa.array(out, mask=~ok)

    return lambda target, item: layers(target.cast("array<double>"), item.cast("array<double>"))


def _whole(vectors: pa.Array, size: int) -> np.ndarray:
    """Which vectors have `size` numbers, none of them missing."""
    ok = pc.equal(pc.list_value_length(vectors), size).fill_null(False).to_numpy(zero_copy_only=False).copy()
    lacking = pc.list_parent_indices(vectors).filter(pc.is_null(pc.list_flatten(vectors)))
    ok[lacking.to_numpy()] = False
    return ok


_NAMES = ("_key", "_rows", "_most", "_total", "_sum")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of equal keys that follow each other: _rows, and of rows with a score the largest (_most), the weights relative to
    it (_total) and the vectors by these weights (_sum). The last key of a batch is held back, since it may go on. Rows without
    a key stay apart."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        key = batch.column("_key").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[True], key[1:] != key[:-1]]) | (key < 0)
        first, run = np.flatnonzero(begins), np.cumsum(begins) - 1
        scored = pc.and_(batch.column("_most").is_valid(), batch.column("_sum").is_valid())
        own = run[scored.to_numpy(zero_copy_only=False)]
        most, total, rows = np.zeros(len(first)), np.zeros(len(first)), np.add.reduceat(batch.column("_rows").to_numpy(), first)
        sums, sizes = [], np.zeros(len(first), np.int64)
        if len(own):
            score, weight, vectors = (batch.column(c).filter(scored) for c in ("_most", "_total", "_sum"))
            score, weight, widths = score.to_numpy(), weight.to_numpy(), pc.list_value_length(vectors).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            told = own[start]
            sizes[told] = widths[start]
            if (widths != sizes[own]).any():
                raise ValueError("vectors of one key differ in length")
            most[told] = np.maximum.reduceat(score, start)
            with np.errstate(invalid="ignore"):
                share = np.exp(score - most[own])
            total[told] = np.add.reduceat(share * weight, start)
            flat = vectors.flatten().to_numpy() * np.repeat(share, widths)
            for at, upto in _even(widths):
                here = start[(start >= at) & (start < upto)] - at
                own_part = flat[widths[:at].sum() : widths[:upto].sum()].reshape(upto - at, -1)
                sums.append(np.add.reduceat(own_part, here, 0).ravel())
        none = pa.array(np.bincount(own, minlength=len(first)) == 0)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sums, np.zeros(0)])), mask=none)
        lists = lists.cast(batch.schema.field("_sum").type)
        absent = none.to_numpy(zero_copy_only=False)
        out = [batch.column("_key").take(pa.array(first)), pa.array(rows), pa.array(most, mask=absent), pa.array(total, mask=absent), lists]
        found = pa.RecordBatch.from_arrays(out, schema=batch.schema)
        held = found.slice(found.num_rows - 1)
        yield found.slice(0, found.num_rows - 1)
    if held is not None:
        yield held


def _even(widths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose vectors have one length."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(widths)) + 1, [len(widths)]])
    return zip(cuts[:-1], cuts[1:])


def attention_pool(df: DataFrame, vectors: DataFrame, key: str, target: str, history: str, score: Callable[[Column, Column], Column] = scaled_dot) -> DataFrame:
    """key and `interest`, for each row the attention-weighted sum of its history items' vectors; `vectors` is (id, vector).

    `score` tells an item's score from the target's vector and its own, such as `scaled_dot`, `dot` or a `learned_score`. Rows
    without a scored item have a NULL interest, which stands for a zero vector. Each item stays one row up to its score; rows of
    one key that follow each other are then added up where they are, so one row for each key is shuffled, not its items, and is
    added up with the key's other rows. `df` is read once: each of its rows is a row without an item, which meets no vector."""
    text = lambda c: c.cast("string")
    entry = lambda item, rows: F.struct(item.alias("item"), F.lit(rows).cast("long").alias("rows"))
    given = F.coalesce(F.col(history), F.array().cast(df.schema[history].dataType))
    entries = F.concat(F.array(entry(text(F.col(target)), 1)), F.transform(given, lambda x: entry(text(x), 0)))
    items = df.select(F.col(key).alias("_key"), text(F.col(target)).alias("_target"), F.explode(entries).alias("_e"))
    items = items.select("_key", "_target", F.col("_e.item").alias("_item"), F.col("_e.rows").alias("_rows"))
    told = vectors.select(text(F.col("id")).alias("_id"), F.col("vector").cast("array<double>").alias("_vec"), F.lit(0).cast("long").alias("_zero"))
    joined = items.join(told.select(F.col("_id").alias("_ti"), F.col("_vec").alias("_tv"), F.col("_zero").alias("_tz")), (F.col("_target") == F.col("_ti")) & (F.col("_rows") == F.col("_tz")), "left")
    joined = joined.join(told, (F.col("_item") == F.col("_id")) & (F.col("_rows") == F.col("_zero")), "left")
    scored = joined.select("_key", "_rows", score(F.col("_tv"), F.col("_vec")).alias("_s"), F.col("_vec").alias("_sum"))
    scored = scored.select("_key", "_rows", F.when(F.col("_key").isNotNull(), F.col("_s")).alias("_most"), F.lit(1.0).alias("_total"), "_sum")
    schema = StructType([StructField("_key", df.schema[key].dataType), *(StructField(c, t) for c, t in zip(_NAMES[1:], (LongType(), DoubleType(), DoubleType(), ArrayType(DoubleType()))))])
    pooled = scored.mapInArrow(_summed, schema).repartition("_key").sortWithinPartitions("_key").mapInArrow(_summed, schema)
    interest = F.transform("_sum", lambda x: x / F.col("_total")).alias("interest")
    each = pooled.where("_rows > 0").select(F.col("_key").alias(key), interest, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return each.select(key, "interest")


def interest_counts(df: DataFrame, target: str, history: str, prefix: str) -> DataFrame:
    """How often the target value occurs in the history, its share of the history, and how long ago, counted in items, it came
    last (NULL if it never did)."""
    h, n = F.coalesce(F.col(history), F.array().cast(df.schema[history].dataType)), F.size(F.coalesce(F.col(history), F.array().cast(df.schema[history].dataType)))
    same = F.size(F.filter(h, lambda x: x.eqNullSafe(F.col(target)) & x.isNotNull()))
    return df.withColumns({
        f"{prefix}_hits": same.cast("long"),
        f"{prefix}_share": F.when(n > 0, same / n).otherwise(F.lit(0.0)),
        f"{prefix}_ago": F.nullif(F.array_position(F.reverse(h), F.col(target)), F.lit(0)).cast("long"),
    })


def interest_features(df: DataFrame, vectors: DataFrame, key: str, target: str, history: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with `interest` (zeros without history) and the counts of each field: name -> (target column, history column)."""
    df = written(df)  # read twice
    zeros = F.array_repeat(F.lit(0.0), F.coalesce(vectors.select(F.size("vector")).limit(1).scalar(), F.lit(0)))
    pooled = attention_pool(df, vectors, key, target, history).select(F.col(key).alias("_k"), "interest")
    out = df.join(pooled, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("interest", F.coalesce("interest", zeros))
    for name, (t, h) in fields.items():
        out = interest_counts(out, t, h, name)
    return out


