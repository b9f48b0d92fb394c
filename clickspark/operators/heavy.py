"""Keys with so many rows that one task should not sort them: found by their counts, and dealt into ranges of time.

Rows of all other keys stay together and need one window. A heavy key's ranges end at quantiles of its own times, so they are
nearly even however its rows lie over the days; equal times always share a range. What came before a range is added from
totals of ranges, a small table that is broadcast: it has at most `MOST_HEAVY` times `RANGES` rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows from which a key is heavy, the most heavy keys that are dealt (the heaviest), and the ranges of each.
HEAVY_ROWS, MOST_HEAVY, RANGES = 1_000_000, 1024, 64


def ticks(time: str, df: DataFrame) -> Column:
    """A time as a number in the same order: days of dates, microseconds of times, without a look at zones."""
    kind = df.schema[time].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    return {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, F.col)(time)


@dataclass
class Heavy:
    """Ends of the ranges of each heavy key, or None where no key is heavy."""

    keys: Sequence[str]
    time: str
    ends: DataFrame | None

    def ranged(self, df: DataFrame) -> DataFrame:
        """Adds _range: 0 for rows of other keys and for rows without a time, which come first."""
        if self.ends is None:
            return df.withColumn("_range", F.lit(0))
        told = self.ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), "_ends")
        same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(self.keys)]
        at = ticks(self.time, df)
        joined = df.join(F.broadcast(told), same, "left").withColumn("_range", F.when(F.col("_ends").isNull(), F.lit(0)).otherwise(F.size(F.filter("_ends", lambda e: e < at))))
        return joined.drop("_ends", *(f"_k{i}" for i in range(len(self.keys))))

    def summed(self, ranged: DataFrame, **totals: Column) -> DataFrame:
        """The keys (as _k0, _k1 ...), _range and totals of the heavy keys' ranges; bounded, so it may be broadcast."""
        told = self.ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)))
        same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(self.keys)]
        names = [f"_k{i}" for i in range(len(self.keys))]
        return ranged.join(F.broadcast(told), same).groupBy(*names, F.col("_range").alias("_of")).agg(*(c.alias(n) for n, c in totals.items()))

    def told(self, ranged: DataFrame, summed: DataFrame) -> DataFrame:
        """The rows with what is known of their range; NULL for rows of other keys."""
        same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(self.keys)]
        return ranged.join(F.broadcast(summed), [*same, F.col("_range") == F.col("_of")], "left").drop("_of", *(f"_k{i}" for i in range(len(self.keys))))


def heavy(df: DataFrame, keys: Sequence[str], time: str, rows: int | None = None) -> Heavy:
    """The heavy keys of a table (rows with all key parts), which are looked at once: a count of keys, and where some are heavy the
    quantiles of their times."""
    rows = HEAVY_ROWS if rows is None else rows
    present = df.select(*keys, ticks(time, df).alias("_at")).dropna(subset=list(keys))
    counted = present.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    most = written(counted.orderBy(F.desc("_n"), *keys).limit(MOST_HEAVY))
    if most.isEmpty():
        return Heavy(keys, time, None)
    own = present.join(F.broadcast(most), list(keys))
    ends = F.percentile_approx("_at", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)
    return Heavy(keys, time, written(own.groupBy(*keys).agg(F.array_distinct(ends).alias("_ends"))))
