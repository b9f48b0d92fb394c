"""Profiling aggregates with partial aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
TAILS = (20, 50, 100, 200)


def ctr_by(df: DataFrame, *keys: str, label: str = "clk") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(label).alias("n"), F.avg(label).alias("ctr"))


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """value, n and share, most frequent first; with dropna the share is of the rows that have a value."""
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: n_rows, and for each column its distinct values, counted column by column from the distinct values alone; or
    estimates, all in one pass."""
    if approximate:
        return df.agg(F.count("*").alias("n_rows"), *(F.approx_count_distinct(c).alias(f"n_{c}") for c in columns))
    own = lambda c: df.select(c).distinct().agg(F.count(c)).scalar()
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", *(own(c).alias(f"n_{c}") for c in columns))


def distinct_sketches(df: DataFrame, columns: Sequence[str], part: Column, bits: int = 12) -> DataFrame:
    """part, n_rows and a sketch of the distinct values of each column, one row for each part such as the day. Sketches of different
    parts can be united later, without the rows; their error is about 1.04 / 2^(bits / 2)."""
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"), *(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(c) for c in columns))


def united_counts(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_rows, and the estimated distinct values of each column over all the parts given."""
    return sketches.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(f"n_{c}") for c in columns))


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name and missing_rate, highest first, from one pass."""
    columns = list(columns or df.columns)
    rates = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return rates.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, missing_rate)").orderBy(F.desc("missing_rate"), "column_name")


def time_range(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def table_summary(df: DataFrame) -> DataFrame:
    """position, column_name, type, n_rows: the shape of a table."""
    n = df.agg(F.count("*").alias("n_rows"))
    told = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema))))
    return n.select(told.alias("c"), "n_rows").select("c.*", "n_rows")


def head(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in the order of a key, so that they are the same each time."""
    return df.orderBy(*key).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows, chosen by hash of seed and key, the same whatever the partitioning."""
    return sample_by_rank(df, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key, n)


def sample_by_rank(df: DataFrame, rank: Column, key: str, n: int) -> DataFrame:
    """As sample_rows with any deterministic rank."""
    return df.orderBy(rank, key).limit(n)


def last_dates(df: DataFrame, k: int, date: str = "date") -> DataFrame:
    return df.select(date).where(F.col(date).isNotNull()).distinct().orderBy(F.desc(date)).limit(k)


def distinct_users(df: DataFrame, user: str = "user_key") -> DataFrame:
    """Each user once; rows without a user count for nobody."""
    return df.select(user).where(F.col(user).isNotNull()).distinct()


def behavior_counts_per_user(log: DataFrame, user: str = "user_key") -> DataFrame:
    return log.groupBy(user).agg(F.count("*").alias("n_behaviors"))


def quantiles(df: DataFrame, column: str, at: Sequence[float], ranges: int = 256) -> DataFrame:
    """One row with a list `q` of exact quantiles, interpolated linearly between the two nearest ranks; NULL without values.

    Rows are first counted by value, which is written once. Values are dealt into ranges by approximate bounds, which only place them: ranks are running
    sums within a range and the sums of the ranges before it, so no task holds all distinct values."""
    by = written(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")))
    bounds = by.agg(F.array_distinct(F.percentile_approx("v", [i / ranges for i in range(1, ranges)]))).scalar()
    dealt = by.withColumn("_bounds", bounds).withColumn("r", F.size(F.filter("_bounds", lambda b: b < F.col("v")))).drop("_bounds")
    sums = dealt.groupBy("r").agg(F.sum("n").alias("_all"))
    before = sums.select("r", (F.sum("_all").over(Window.orderBy("r")) - F.col("_all")).alias("_before"))
    own = F.sum("n").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = dealt.withColumn("_own", own).join(F.broadcast(before), "r").select("v", (F.col("_before") + F.col("_own")).alias("upto"), "n")  # at most `ranges` rows are broadcast
    total = sums.agg(F.sum("_all")).scalar()
    place = lambda p: (total - 1) * F.lit(float(p))
    holds = lambda k: (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
    ends = ranked.agg(*(F.max(F.when(holds(f(place(p))), F.col("v"))).alias(f"_{i}{name}") for i, p in enumerate(at) for name, f in (("low", F.floor), ("high", F.ceil))))
    share = lambda p: place(p) - F.floor(place(p))
    return ends.select(F.array(*(F.col(f"_{i}low") + (F.col(f"_{i}high") - F.col(f"_{i}low")) * share(p) for i, p in enumerate(at))).alias("q"))


def length_quantiles(df: DataFrame, column: str, at: Sequence[float] = QUANTILES, approximate: bool = False) -> DataFrame:
    """One row with a column q<percent> for each quantile, interpolated linearly (or approximate, for very many rows)."""
    told = df.agg(F.percentile_approx(column, list(at)).alias("q")) if approximate else quantiles(df, column, at)
    return told.select(*(F.get("q", F.lit(i)).cast("double").alias(f"q{round(100 * p)}") for i, p in enumerate(at)))


def tail_shares(df: DataFrame, column: str, above: Sequence[int] = TAILS) -> DataFrame:
    return df.agg(*(F.avg((F.col(column) > k).cast("int")).alias(f"over_{k}") for k in above))


def mean_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.max(column).alias("max"))


def log_coverage(log: DataFrame, exposures: DataFrame, user: str = "user_key", brand: str = "brand") -> DataFrame:
    """hit_rows, hit_users, user_share and brand_missing of the behaviours of exposed users."""
    exposed = distinct_users(exposures, user)
    hits = log.join(exposed, user, "left_semi").agg(F.count("*").alias("hit_rows"), F.count_distinct(user).alias("hit_users"), F.avg(F.col(brand).isNull().cast("int")).alias("brand_missing"))
    total = exposed.agg(F.count("*")).scalar()
    return hits.withColumn("user_share", F.col("hit_users") / total)


def seq_len_summary(df: DataFrame, column: str = "seq_len") -> DataFrame:
    q = quantiles(df, column, (0.25, 0.5, 0.75, 0.9)).scalar()
    told = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")).withColumn("q", q)
    return told.select("n", "mean", "std", "min", "max", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90"))))


def day_count_audit(tables: Mapping[str, DataFrame], day: Mapping[str, Column]) -> DataFrame:
    """date, rows of each table on that date, and whether all tables agree."""
    out = None
    for name, df in tables.items():
        counted = df.groupBy(day[name].alias("date")).agg(F.count("*").alias(f"n_{name}"))
        out = counted if out is None else out.join(counted, "date", "full_outer")
    names = [f"n_{n}" for n in tables]
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    agree = F.lit(True)
    for n in names[1:]:
        agree = agree & (F.col(n) == F.col(names[0]))
    return out.withColumn("agrees", agree)


def mean_click_rate(df: DataFrame, split: str = "split", label: str = "clk") -> DataFrame:
    return df.groupBy(split).agg(F.avg(label).alias("click_rate"), F.count("*").alias("n"))


