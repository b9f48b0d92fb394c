"""Projections, filters and cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def fill_unknown(df: DataFrame, columns: Sequence[str], value: int = -1) -> DataFrame:
    """Missing categories become a code of their own."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def fill_zero_history(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def shift_unknown(df: DataFrame, columns: Sequence[str], by: int = 1) -> DataFrame:
    """Codes that begin at -1 begin at 0, so that unknown is class 0."""
    return df.withColumns({c: F.col(c) + by for c in columns})


def filter_btag(log: DataFrame, btag: str = "pv") -> DataFrame:
    return log.where(F.col("btag") == btag)


def filter_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the members; never multiplies rows."""
    return df.join(members.select(key).distinct(), key, "left_semi")


def date_equals(df: DataFrame, date, column: str = "date") -> DataFrame:
    return df.where(F.col(column) == F.lit(date))


def date_in(df: DataFrame, dates: Iterable, column: str = "date") -> DataFrame:
    return df.where(F.col(column).isin(list(dates)))


def date_not(df: DataFrame, dates: Iterable, column: str = "date") -> DataFrame:
    return df.where(~F.col(column).isin(list(dates)))


def add_time_parts(df: DataFrame, at: str = "ts", zone: str | None = None) -> DataFrame:
    """hour, weekday (Monday 0) and date of a UTC time, in a local zone or, by default, in UTC."""
    from ..functions import local_time, weekday

    t = F.col(at) if zone is None else local_time(F.col(at), zone)
    return df.withColumns({"hour": F.hour(t), "weekday": weekday(t), "date": F.to_date(t)})
