"""Ranking and probability metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def auc(df: DataFrame, score: str = "score", label: str = "clk", ranges: int = 1024) -> DataFrame:
    """One row, `auc`: the chance that a positive row scores above a negative one; ties count half.

    Rows are first added up by distinct score, which is written once. Scores are then dealt into ranges by quantiles: negatives below a score are those
    in lower ranges, from a small table, and those lower in its own range, so that no window spans all scores."""
    by = written(df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(label).alias("p"), (F.count("*") - F.sum(label)).alias("n")))
    bounds = by.agg(F.array_distinct(F.percentile_approx("s", [i / ranges for i in range(1, ranges)]))).scalar()
    dealt = by.withColumn("_bounds", bounds).withColumn("r", F.size(F.filter("_bounds", lambda b: b < F.col("s")))).drop("_bounds")
    sums = dealt.groupBy("r").agg(F.sum("n").alias("rn"))
    lower = sums.select("r", (F.sum("rn").over(Window.orderBy("r")) - F.col("rn")).alias("below"))
    w = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("own", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(lower), "r")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("own") + F.col("n") / 2.0))
    return ranked.agg(F.try_divide(wins, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def logloss_term(p: Column, y: Column, clip: float = 1e-15) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def logloss(df: DataFrame, score: str = "score", label: str = "clk", clip: float = 1e-15) -> DataFrame:
    """One row, `logloss`: the mean negative log-likelihood."""
    return df.agg(F.avg(logloss_term(F.col(score), F.col(label), clip)).alias("logloss"))
