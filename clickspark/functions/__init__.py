"""Column functions: local time, text keys, ratios, and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Shanghai"


def epoch_to_ntz(seconds: Column | str) -> Column:
    """Epoch seconds as UTC wall-clock time."""
    at = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=at.cast("decimal(18,6)"))


def local_time(utc: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall-clock time (timestamp_ntz) in another zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def weekday(at: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(at)


def text_key(value: Column) -> Column:
    """A value as a key text; missing is `nan`, whole numbers have no fraction."""
    return F.coalesce(value.cast("string"), F.lit("nan"))


def cross(*values: Column) -> Column:
    """Several values as one key, joined by an underscore."""
    return F.concat_ws("_", *(text_key(v.cast("long")) for v in values))


def smoothed_rate(hits: Column, tries: Column, a: float, b: float) -> Column:
    return (hits + F.lit(a)) / (tries + F.lit(b))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def last_n(values: Column, n: int) -> Column:
    """The last n items; all of a shorter list."""
    return F.slice(values, F.greatest(F.size(values) - F.lit(n - 1), F.lit(1)), F.lit(n))


def field_of(structs: Column, name: str) -> Column:
    return F.transform(structs, lambda x: x[name])


def pad(values: Column, n: int, value=0) -> Column:
    """A list of exactly n items: cut, or filled on the right."""
    return F.concat(F.slice(values, 1, n), F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(n) - F.size(values), F.lit(0))))


def mask(length: Column, n: int) -> Column:
    """n flags, true while the position is below the length."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < length)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)
