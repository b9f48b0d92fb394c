"""Splits by date: the newest dates are held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import last_dates


def _newest(df: DataFrame, k: int, date: str) -> list:
    dates = [r[0] for r in last_dates(df, k, date).collect()]
    if len(dates) < k:
        raise ValueError(f"a split needs {k + 1} dates; newest found: {dates}")
    return dates


def split_last_date(df: DataFrame, date: str = "date", drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train (all earlier dates) and valid (the newest date)."""
    (newest,) = _newest(df, 1, date)
    parts = df.where(F.col(date) != newest), df.where(F.col(date) == newest)
    return tuple(p.drop(date) for p in parts) if drop else parts


def split_three_way(df: DataFrame, date: str = "date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, valid (the newest date but one) and test (the newest)."""
    newest, second = _newest(df, 2, date)
    return df.where(F.col(date) < second), df.where(F.col(date) == second), df.where(F.col(date) == newest)


def named_split(df: DataFrame, k: int, date: str = "date") -> DataFrame:
    """The rows with a column split, without a look at the driver: the newest dates are ranked in the plan."""
    told = last_dates(df, k, date).select(F.col(date).alias("_d"))
    least, most = told.agg(F.min("_d")).scalar(), told.agg(F.max("_d")).scalar()
    if k == 1:
        return df.withColumn("split", F.when(F.col(date) == most, "valid").otherwise("train"))
    return df.withColumn("split", F.when(F.col(date) == most, "test").when(F.col(date) == least, "valid").otherwise("train"))
