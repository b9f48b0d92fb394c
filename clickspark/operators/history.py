"""Point-in-time counters: what was known of a key before each row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import smoothed_rate
from .heavy import heavy, ticks


def _present(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _named(df: DataFrame, prefix: str, keys: Sequence[str], imp: Column, clk: Column, a: float, b: float) -> DataFrame:
    """Adds <prefix>_hist_imp, _clk and _ctr; a row with a missing key part has imp NULL, clk 0 and ctr NULL."""
    imp = F.when(_present(keys), imp.cast("long"))
    clk = F.when(_present(keys), F.coalesce(clk, F.lit(0))).otherwise(F.lit(0)).cast("long")
    out = df.withColumns({f"{prefix}_hist_imp": imp, f"{prefix}_hist_clk": clk})
    return out.withColumn(f"{prefix}_hist_ctr", smoothed_rate(F.col(f"{prefix}_hist_clk"), F.col(f"{prefix}_hist_imp"), a, b))


def history(df: DataFrame, keys: Sequence[str], prefix: str, order: Sequence[str], label: str = "clk", a: float = 0.25, b: float = 5.0, heavy_rows: int | None = None) -> DataFrame:
    """Earlier rows and earlier labels of the key in row order; `order` begins with a time, of which NULL is the earliest, and must
    end in a tie-breaker. One window does for all keys but those with more than `heavy_rows` rows, see `heavy`."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    return _by_range(df, keys, prefix, order[0], label, F.struct(*order), lambda w: F.row_number().over(w) - 1, before, a, b, heavy_rows)


def _by_range(df: DataFrame, keys: Sequence[str], prefix: str, time: str, label: str, own: Column, imp: Callable, frame: Callable, a: float, b: float, heavy_rows: int | None) -> DataFrame:
    """Counts of `imp` and the labels of `frame` within a key's range of time, and what the ranges before hold of heavy keys."""
    kept, told = df.columns, heavy(df, keys, time, heavy_rows)
    rows = told.ranged(df)
    w = Window.partitionBy(*keys, "_range", "_spread").orderBy(own)
    out = rows.withColumn("_spread", _spread(keys, kept)).withColumns({"_i": imp(w), "_l": F.coalesce(F.sum(label).over(frame(w)), F.lit(0))})
    n, c = F.lit(0), F.lit(0)
    if told.ends is not None:
        past = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
        totals = told.summed(rows, _n=F.count("*"), _c=F.sum(label))
        totals = totals.withColumns({"_n0": F.sum("_n").over(past), "_c0": F.sum("_c").over(past)}).drop("_n", "_c")
        out = told.told(out, totals)
        n, c = F.coalesce("_n0", F.lit(0)), F.coalesce("_c0", F.lit(0))
    out = _named(out, prefix, keys, n + F.col("_i"), c + F.col("_l"), a, b)
    return out.select(*kept, f"{prefix}_hist_imp", f"{prefix}_hist_clk", f"{prefix}_hist_ctr")


def _spread(keys: Sequence[str], columns: Sequence[str]) -> Column:
    """Zero for rows with all key parts. Others have a fixed result, so they are dealt into many parts instead of meeting."""
    return F.when(_present(keys), F.lit(0)).otherwise(F.pmod(F.xxhash64(*columns), F.lit(1024)).cast("int"))


def _by_day(df: DataFrame, keys: Sequence[str], prefix: str, day: Column, label: str, own: Column, imp: Callable, frame: Callable, a: float, b: float) -> DataFrame:
    """Counts of the key's earlier days from day totals, and `imp` and the labels of `frame` within the day."""
    kept = df.columns
    rows = df.withColumns({"_day": day, "_spread": _spread(keys, kept)})
    totals = rows.where(_present(keys)).groupBy(*keys, "_day").agg(F.count("*").alias("_n"), F.sum(label).alias("_c"))
    past = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_day", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_c").over(past), F.lit(0)).alias("_c0"))
    w = Window.partitionBy(*keys, "_day", "_spread").orderBy(own)
    within = rows.withColumns({"_i": imp(w), "_l": F.coalesce(F.sum(label).over(frame(w)), F.lit(0))})
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_day").alias("_d"), "_n0", "_c0")
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    joined = within.join(totals, [*same, F.col("_day").eqNullSafe(F.col("_d"))], "left")
    out = _named(joined, prefix, keys, F.col("_n0") + F.col("_i"), F.col("_c0") + F.col("_l"), a, b)
    return out.select(*kept, f"{prefix}_hist_imp", f"{prefix}_hist_clk", f"{prefix}_hist_ctr")


def history_by_day(df: DataFrame, keys: Sequence[str], prefix: str, order: Sequence[str], day: Column, label: str = "clk", a: float = 0.25, b: float = 5.0) -> DataFrame:
    """The same result as `history` when `order` begins with a time and `day` is that time's day. Windows span one day of a
    key, and what came before the day is added from day totals, so that a very frequent key is not one task's work."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    return _by_day(df, keys, prefix, day, label, F.struct(*order), lambda w: F.row_number().over(w) - 1, before, a, b)


def history_strict(df: DataFrame, keys: Sequence[str], prefix: str, time: str, day: Column | None = None, label: str = "clk", a: float = 0.25, b: float = 5.0, heavy_rows: int | None = None) -> DataFrame:
    """As `history`, but only rows at strictly earlier times count, so that ties never see each other; rows without a time tie
    before all others. With `day` windows span one day of a key instead of the ranges of heavy keys."""
    at = F.coalesce(ticks(time, df).cast("double" if df.schema[time].dataType.typeName() in ("double", "float") else "long"), F.lit(-(1 << 62)))
    before = lambda w: w.rangeBetween(Window.unboundedPreceding, -1)
    imp = lambda w: F.count("*").over(before(w))
    if day is not None:
        return _by_day(df, keys, prefix, day, label, at, imp, before, a, b)
    return _by_range(df, keys, prefix, time, label, at, imp, before, a, b, heavy_rows)
