"""Behaviour sequences strictly before each exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import last_n
from .heavy import Heavy, heavy


#: Behaviours that one row of a collected log holds; users with more have several rows.
LOG_BLOCK = 10_000


def collect_user_log(log: DataFrame, fields: Sequence[str], user: str = "user_key", time: str = "ts", tie: str = "event_id", n: int = LOG_BLOCK, part: Column | None = None) -> DataFrame:
    """user, block and `log`: the user's behaviours as structs (time, tie, fields) in time order, n to a block, blocks from 0. For
    `part`, such as the day, see `_running`."""
    entry = F.struct(F.col(time), F.col(tie), *(F.col(f) for f in fields if f not in (time, tie)))
    ranked = _running(log.withColumn("_one", F.lit(1)), user, [time, tie], "_one", part)
    return ranked.groupBy(user, F.floor((F.col("_run") - 1) / n).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("log"))


def asof_history_simple(exposures: DataFrame, log: DataFrame, fields: Sequence[str], n: int = 220, user: str = "user_key", time: str = "ts", tie: str = "event_id", longest: int = LOG_BLOCK) -> DataFrame:
    """Adds `hist` (the last n behaviours strictly before the exposure, oldest first) and `seq_len`. Each exposure carries its
    user's whole log through the join, so this plan is for short logs; users with more than `longest` behaviours take the plan
    of `asof_history`."""
    many = log.groupBy(user).agg(F.count("*").alias("_count")).where(F.col("_count") > longest).select(user)
    entry = F.struct(F.col(time), F.col(tie), *(F.col(f) for f in fields if f not in (time, tie)))
    told = log.join(many, user, "left_anti").groupBy(user).agg(F.sort_array(F.collect_list(entry)).alias("log"))
    joined = exposures.join(many, user, "left_anti").join(told, user, "left")
    before = F.filter(F.coalesce("log", F.array()), lambda x: x[time] < F.col(time))
    hist = F.transform(last_n(before, n), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    short = joined.withColumn("hist", hist).withColumn("seq_len", F.size("hist")).select(*exposures.columns, "hist", "seq_len")
    rest = asof_history(exposures.join(many, user, "left_semi"), log.join(many, user, "left_semi"), fields, n, user, time, tie)
    return short.unionByName(rest)


def _running(df: DataFrame, user: str, order: Sequence[str], value: str, part: Column | None, told: Heavy | None = None) -> DataFrame:
    """Adds _run, the sum of `value` over the user's rows up to this one. Users with very many rows are found by their counts (or
    `told`) and dealt into ranges of time, see `heavy`. With `part`, a coarser time that never falls as time goes on, windows
    span one part of any user instead, and the parts before are added from totals."""
    if part is None:
        told = heavy(df, [user], order[0]) if told is None else told
        rows = told.ranged(df)
        w = Window.partitionBy(user, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = rows.withColumn("_run", F.sum(value).over(w))
        if told.ends is not None:
            past = Window.partitionBy("_k0").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
            totals = told.summed(rows, _t=F.sum(value)).withColumn("_t", F.sum("_t").over(past))
            own = told.told(own, totals).withColumn("_run", F.col("_run") + F.coalesce("_t", F.lit(0))).drop("_t")
        return own.drop("_range")
    rows = df.withColumn("_part", part)
    past = Window.partitionBy("_u").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(user).alias("_u"), F.col("_part").alias("_p")).agg(F.sum(value).alias("_t"))
    totals = totals.select("_u", "_p", F.coalesce(F.sum("_t").over(past), F.lit(0)).alias("_t"))
    w = Window.partitionBy(user, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("_run", F.sum(value).over(w))
    joined = own.join(totals, F.col(user).eqNullSafe(F.col("_u")) & F.col("_part").eqNullSafe(F.col("_p")))
    return joined.withColumn("_run", F.col("_run") + F.col("_t")).drop("_part", "_u", "_p", "_t")


def _known(rows: DataFrame, user: str, time: str) -> DataFrame:
    """Rows with a user and a time; no others can precede or be preceded."""
    return rows.where(F.col(user).isNotNull() & F.col(time).isNotNull())


def _sides(exposures: DataFrame, log: DataFrame, user: str, time: str, held: Column, buckets: int | None) -> DataFrame:
    """Exposures (_is 0, with what is held of them) and behaviours (_is 1) as _user, _time; those without user or time stay out.
    With `buckets`, exposures are dealt as the log already is, so that a log in buckets by user is not shuffled."""
    asked = _known(exposures, user, time).select(F.col(user).alias("_user"), F.col(time).alias("_time"), F.lit(0).alias("_is"), held.alias("_held"))
    asked = asked if buckets is None else asked.repartition(buckets, "_user")
    none = F.lit(None).cast(asked.schema["_held"].dataType)
    return asked.unionByName(_known(log, user, time).select(F.col(user).alias("_user"), F.col(time).alias("_time"), F.lit(1).alias("_is"), none.alias("_held")))


def _held(df: DataFrame) -> Column:
    """All columns in one, so that no name of theirs meets one used here."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_held")


def asof_history(exposures: DataFrame, log: DataFrame, fields: Sequence[str], n: int = 220, user: str = "user_key", time: str = "ts", tie: str = "event_id", buckets: int | None = None) -> DataFrame:
    """The same result by blocks of n behaviours. A running count places each exposure in its user's log; it then meets, by user
    and number of block, the block that holds its latest behaviour and the one before. No row carries more than 2 n
    behaviours, and nothing is joined: exposures and blocks are one table, grouped as the counts were. Behaviours without a user
    or a time precede nothing, and exposures without either have no history.

    `buckets` is the number of buckets by user of a log from `materialize_behaviors`, which then is read without a shuffle; all of
    a user's rows then share a bucket, however many they are."""
    known = _known(log, user, time).select(F.col(user).alias("_user"), F.col(time).alias("_time"), F.col(tie).alias("_tie"), F.struct(*(F.col(f) for f in fields)).alias("_f"), F.lit(1).alias("_one"))
    sides = _sides(exposures, log, user, time, _held(exposures), buckets)
    told = heavy(sides, ["_user"], "_time")
    ranked = _running(known, "_user", ["_time", "_tie"], "_one", None, told).withColumn("_r", F.col("_run") - 1)
    blocks = ranked.groupBy("_user", F.floor(F.col("_r") / n).alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_f"))), lambda x: x["_f"]).alias("_items"))
    placed = _running(sides, "_user", ["_time", "_is"], "_is", None, told).where("_is = 0").select("_user", F.floor((F.col("_run") - 1) / n).alias("_b"), "_held", F.col("_run").alias("_n"))
    none = F.array().cast(blocks.schema["_items"].dataType)
    now = blocks.select("_user", "_b", F.col("_items").alias("_now"))
    before = blocks.select("_user", (F.col("_b") + 1).alias("_b"), F.col("_items").alias("_before"))
    met = placed.unionByName(now, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)
    same = Window.partitionBy("_user", "_b").orderBy(F.col("_n").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # blocks come first
    met = met.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(same), none) for c in ("_now", "_before")}).where("_n is not null")
    taken = F.slice("_now", F.lit(1), F.greatest(F.col("_n") - F.col("_b") * n, F.lit(0)).cast("int"))
    out = met.select("_held", F.when(F.col("_n") > 0, last_n(F.concat("_before", taken), n)).otherwise(none).alias("_hist"))
    missing = exposures.where(F.col(user).isNull() | F.col(time).isNull()).select(_held(exposures), none.alias("_hist"))
    return out.unionByName(missing).select(*(F.col("_held").getField(c).alias(c) for c in exposures.columns), F.col("_hist").alias("hist"), F.size("_hist").alias("seq_len"))


def in_reach(exposures: DataFrame, log: DataFrame, n: int, user: str = "user_key", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The behaviours that are among the last n before some exposure. A behaviour's place in the user's log is compared with that of
    the next exposure, so no list is built or taken apart."""
    none = F.lit(None).cast(log.select(_held(log)).schema["_held"].dataType)
    asked = _known(exposures, user, time).select(F.col(user).alias("_user"), F.col(time).alias("_time"), F.lit(0).alias("_is"), F.lit(None).cast(log.schema[tie].dataType).alias("_tie"), none.alias("_held"))
    both = asked.unionByName(_known(log, user, time).select(F.col(user).alias("_user"), F.col(time).alias("_time"), F.lit(1).alias("_is"), F.col(tie).alias("_tie"), _held(log)))
    told = heavy(both, ["_user"], "_time")
    placed = told.ranged(_running(both, "_user", ["_time", "_is", "_tie"], "_is", None, told))
    asked_at = F.when(F.col("_is") == 0, F.col("_run"))
    later = Window.partitionBy("_user", "_range").orderBy("_time", "_is", "_tie").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = placed.withColumn("_next", F.min(asked_at).over(later))
    if told.ends is not None:
        after = Window.partitionBy("_k0").orderBy("_of").rowsBetween(1, Window.unboundedFollowing)
        found = told.told(found, told.summed(placed, _first=F.min(asked_at)).withColumn("_first", F.min("_first").over(after)))
        found = found.withColumn("_next", F.coalesce("_next", "_first"))
    kept = found.where((F.col("_is") == 1) & (F.col("_next") - F.col("_run") < n))
    return kept.select(*(F.col("_held").getField(c).alias(c) for c in log.columns))


def prior_count(exposures: DataFrame, log: DataFrame, user: str = "user_key", time: str = "ts", key: str = "event_id", buckets: int | None = None) -> DataFrame:
    """key and n_prior: how many behaviours of the user precede each exposure, whatever the order of the log; 0 without a user or
    a time. For `buckets` see `asof_history`."""
    found = _running(_sides(exposures, log, user, time, F.col(key), buckets), "_user", ["_time", "_is"], "_is", None).where("_is = 0")
    missing = exposures.where(F.col(user).isNull() | F.col(time).isNull()).select(key, F.lit(0).cast("long").alias("n_prior"))
    return found.select(F.col("_held").alias(key), F.col("_run").alias("n_prior")).unionByName(missing)
