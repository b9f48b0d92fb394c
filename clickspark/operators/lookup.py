"""Lookups in dimension tables and coverage of keys.

Ads and profiles grow with the log, and Spark guesses their size from compressed files, so it would send tables of many million rows
through the driver. They are sorted and merged in tasks instead, whatever the guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import distinct_users


def attach_ads(exposures: DataFrame, ads: DataFrame, key: str = "adgroup_id") -> DataFrame:
    """Every exposure once, with its ad's columns or NULLs; a NULL key matches nothing. Keys of ads must be unique."""
    return exposures.join(ads.hint("merge"), key, "left")


def attach_profiles(exposures: DataFrame, profiles: DataFrame, user: str = "user_key", key: str = "userid") -> DataFrame:
    return exposures.join(profiles.hint("merge"), exposures[user] == profiles[key], "left").drop(key)


def restrict_to_users(log: DataFrame, exposures: DataFrame, user: str = "user_key") -> DataFrame:
    """Behaviours of users that were exposed at least once."""
    return log.join(distinct_users(exposures, user), user, "left_semi")


def vocab_lookup(df: DataFrame, vocabulary: DataFrame, column: str, out: str, unknown: int = 1) -> DataFrame:
    """The id of each value's text in a vocabulary (value, id); unknown and missing values get one id."""
    told = vocabulary.select(F.col("value").alias("_value"), F.col("id").alias("_id"))
    return df.join(told, F.col(column).cast("string") == F.col("_value"), "left").withColumn(out, F.coalesce("_id", F.lit(unknown))).drop("_value", "_id")


def coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: share of the left table's rows, and of its distinct keys, whose key is in the right table."""
    keys = right.select(F.col(right_key).alias("_k")).where("_k is not null").distinct()
    counted = left.groupBy(F.col(left_key).alias("_l")).agg(F.count("*").alias("_n"))
    told = counted.join(keys, F.col("_l") == F.col("_k"), "left").withColumn("_hit", F.col("_k").isNotNull().cast("int"))
    return told.agg(
        (F.sum(F.col("_n") * F.col("_hit")) / F.sum("_n")).alias("row_share"),
        (F.sum(F.when(F.col("_l").isNotNull(), F.col("_hit"))) / F.count("_l")).alias("key_share"),
    )
