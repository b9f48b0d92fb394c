"""Categorical codes, vocabularies, sequences of ids, scaling, and model inputs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import FeatureHasher, OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross, pad
from ..sources.shared import written
from .lookup import vocab_lookup

#: Ranges of values that are numbered apart, and values looked at for each range's bound.
RANGES, LOOKED_AT = 64, 50


def numbered(values: DataFrame, offset: int = 0) -> DataFrame:
    """value and id for a table of distinct values, in value order from `offset`.

    Values are dealt into ranges of nearly equal size; each range is numbered by itself and moved by the number of values in the
    ranges before it, so no window spans all values. The bounds are every `LOOKED_AT`-th of a fixed number of values chosen by
    hash, found in the plan without a look at the driver. The values are written once, since several steps read them. Bounds only place values: each value is numbered whatever the bounds."""
    values = written(values)
    few = values.orderBy(F.xxhash64("value"), "value").limit(RANGES * LOOKED_AT).agg(F.sort_array(F.collect_list("value")).alias("_l"))
    bounds = few.select(F.filter("_l", lambda x, i: i % LOOKED_AT == LOOKED_AT - 1)).scalar()
    part = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("value"))), F.lit(0))
    dealt = values.withColumn("_bounds", bounds).withColumn("_part", part).drop("_bounds")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("value")) - 1
    return dealt.join(F.broadcast(before), "_part").select("value", (own + F.col("_before") + offset).cast("long").alias("id"))  # at most RANGES + 1 rows are broadcast


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).where("value is not null").distinct()


def union_values(df: DataFrame, target: str, history: str) -> DataFrame:
    """All values of a column and of a list column, repeats included, as texts."""
    single = df.select(F.col(target).cast("string").alias("value"))
    return single.unionByName(df.select(F.explode(F.transform(history, lambda x: x.cast("string"))).alias("value")))


def dense_codes(df: DataFrame, columns: Sequence[str], given: DataFrame | None = None) -> DataFrame:
    """Each column's values as 0..k-1 in value order, missing as -1.

    The values of all columns are one table, numbered in one pass in the order of column and value, of which each column's
    first number is taken off; it is written once, and each column is joined with its own part. `given` is a table with the
    same values and columns that costs less to read than `df`, such as `df` before counters were added."""
    given = df if given is None else given
    kinds = {c: given.schema[c].dataType.typeName() for c in columns}
    number, fraction = ("byte", "short", "integer", "long", "boolean"), ("float", "double", "decimal")
    as_key = lambda i, c: F.struct(
        F.lit(i).alias("c"), (F.col(c) if kinds[c] in number else F.lit(None)).cast("long").alias("n"), (F.col(c) if kinds[c] in fraction else F.lit(None)).cast("double").alias("x"),
        (F.lit(None) if kinds[c] in (*number, *fraction) else F.col(c)).cast("string").alias("t"),
    )
    keys = given.select(F.explode(F.array(*(F.when(F.col(c).isNotNull(), as_key(i, c)) for i, c in enumerate(columns)))).alias("value")).where("value is not null").distinct()
    told = written(numbered(keys))
    first = told.groupBy("value.c").agg(F.min("id").alias("_first"))
    told = told.join(F.broadcast(first), F.col("value.c") == first["c"]).select(F.col("value").alias("_v"), (F.col("id") - F.col("_first")).alias("_i"))
    for i, c in enumerate(columns):
        own = told.where(F.col("_v.c") == i).select(F.col("_v").alias(f"_v{i}"), F.col("_i").alias(f"_i{i}"))
        df = df.join(own, as_key(i, c) == F.col(f"_v{i}"), "left").withColumn(c, F.coalesce(F.col(f"_i{i}"), F.lit(-1)).cast("long")).drop(f"_v{i}", f"_i{i}")
    return df


def fit_vocab(train: DataFrame, column: str) -> DataFrame:
    """value (text) and id of the training values, from 2; 0 is for padding and 1 for unknown or missing."""
    return numbered(train.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct(), 2)


def fit_shared_vocab(train: DataFrame, target: str, history: str) -> DataFrame:
    """One vocabulary over a column and the list column of its history."""
    return numbered(union_values(train, target, history).where("value is not null").distinct(), 2)


def fit_log_vocab(train: DataFrame, target: str, log: DataFrame, column: str) -> DataFrame:
    """One vocabulary over a column of the training rows and a column of the behaviours that their histories hold (see
    `sequences.in_reach`), so that no list is taken apart."""
    both = train.select(F.col(target).cast("string").alias("value")).unionByName(log.select(F.col(column).cast("string").alias("value")))
    return numbered(both.where("value is not null").distinct(), 2)


def encode_log(log: DataFrame, vocabulary: DataFrame, column: str, out: str, unknown: int = 1) -> DataFrame:
    """Behaviours with the id of a value, attached once to each; histories taken from them then are lists of ids."""
    return vocab_lookup(log, vocabulary, column, out, unknown)


def encode_sequence(df: DataFrame, vocabulary: DataFrame, column: str, key: str, out: str, unknown: int = 1) -> DataFrame:
    """A list's values as ids, order and repeats kept; empty and missing lists give an empty list. `key` must be unique."""
    items = df.select(F.col(key).alias("_key"), F.posexplode(column).alias("_pos", "_item"))
    told = vocabulary.select(F.col("value").alias("_value"), F.col("id").alias("_id"))
    coded = items.join(told, F.col("_item").cast("string") == F.col("_value"), "left").select("_key", "_pos", F.coalesce("_id", F.lit(unknown)).cast("long").alias("_id"))
    lists = coded.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_id"))), lambda x: x["_id"]).alias("_ids"))
    none = F.array().cast("array<bigint>")
    return df.join(lists, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_ids", none)).drop("_key", "_ids")


def pad_sequences(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.withColumn(column, pad(F.col(column), n))


def unseen_values(valid: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Values of a column that training never had."""
    return distinct_values(valid, column).join(distinct_values(train, column), "value", "left_anti")


def vocab_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the size of each id space, the largest id and one."""
    return df.agg(*((F.max(c) + 1).cast("long").alias(c) for c in columns))


def fit_moments(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and sample deviation of each column, from training rows."""
    return train.agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def standardize(df: DataFrame, moments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std by training moments; a deviation of 0 counts as 1."""
    mean, std = (lambda c: moments.select(f"{c}_mean").scalar()), (lambda c: moments.select(f"{c}_std").scalar())
    return df.withColumns({c: (F.col(c) - mean(c)) / F.when(std(c) == 0, F.lit(1.0)).otherwise(std(c)) for c in columns})


def add_cross(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, cross(F.col(a), F.col(b)))


def top_k_or_other(df: DataFrame, train: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """1..k for the k most frequent training values (ties by value), 0 for all others."""
    counted = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    best = counted.orderBy(F.desc("_n"), "_v").limit(k).select("_v", F.row_number().over(Window.orderBy(F.desc("_n"), "_v")).alias("_i"))
    return df.join(F.broadcast(best), F.col(column) == F.col("_v"), "left").withColumn(out, F.coalesce("_i", F.lit(0)).cast("long")).drop("_v", "_i")


@dataclass
class OneHot:
    """Fitted codes: a table (c, text, id), numbered within each column. Only the columns' sizes are known on the driver."""

    columns: Sequence[str]
    codes: DataFrame
    sizes: Sequence[int]
    model: OneHotEncoderModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds <column>_hot, a sparse vector with one place for each training category; unseen and missing are all zeros."""
        held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("held"), *(F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(self.columns)))
        for i, size in enumerate(self.sizes):
            own = self.codes.where(F.col("c") == i).select(F.col("text").alias(f"t{i}"), F.col("id").cast("double").alias(f"i{i}"))
            held = held.join(own, f"t{i}", "left").withColumn(f"i{i}", F.coalesce(f"i{i}", F.lit(float(max(size, 1)))))
        kept, made = self.model.transform(held), [f"{c}_hot" for c in self.columns]
        return kept.select(*(F.col("held").getField(c).alias(c) for c in df.columns if c not in made), *(F.col(f"h{i}").alias(c) for i, c in enumerate(made)))


def one_hot(train: DataFrame, columns: Sequence[str]) -> OneHot:
    """Numbers the values of all columns in one pass, in the order of their texts; no list of values reaches the driver."""
    values = train.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)))).alias("value")).where("value.text is not null").distinct()
    told = written(numbered(values).select("value.c", "value.text", "id"))
    first = {r["c"]: (r["n"], r["first"]) for r in told.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()}  # a row for each column
    sizes = [first.get(i, (0, 0))[0] for i in range(len(columns))]
    start = F.element_at(F.array(*(F.lit(first.get(i, (0, 0))[1]).cast("long") for i in range(len(columns)))), F.col("c") + 1)
    names = [f"i{i}" for i in range(len(columns))]
    largest = train.sparkSession.createDataFrame([tuple(float(max(size, 1) - 1) for size in sizes)], ", ".join(f"{c} double" for c in names))
    model = OneHotEncoder(inputCols=names, outputCols=[f"h{i}" for i in range(len(columns))], handleInvalid="keep", dropLast=True).fit(largest)
    return OneHot(columns, told.withColumn("id", F.col("id") - start), sizes, model)


def hashed(df: DataFrame, columns: Sequence[str], out: str, size: int = 1 << 18) -> DataFrame:
    """Columns hashed into one sparse vector, for category sets too large to index."""
    return FeatureHasher(inputCols=list(columns), outputCol=out, numFeatures=size, categoricalCols=list(columns)).transform(df)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)
