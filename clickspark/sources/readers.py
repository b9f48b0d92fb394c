"""Readers of the raw tables and of built samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from .. import schemas


def clean_headers(df: DataFrame) -> DataFrame:
    """Blanks around column names go."""
    return df.toDF(*(c.strip() for c in df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in fractional columns becomes NULL, so that means and counts leave it out."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(kinds[c], (DoubleType, FloatType)) else F.col(c) for c in df.columns))


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """The table itself; raises if a key occurs twice, since a lookup would then multiply rows."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} = {twice[0][0]} occurs {twice[0][1]} times")
    return df


def _csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return nan_to_null(clean_headers(spark.read.schema(schema).csv(path, header=True, enforceSchema=True, nullValue="")))


def read_exposures(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Exposures from CSV with a header; max_rows is for trials only."""
    df = _csv(spark, path, schemas.EXPOSURES)
    return df if max_rows is None else df.limit(max_rows)


def read_ads(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    df = _csv(spark, path, schemas.ADS)
    return check_unique(df, "adgroup_id") if check else df


def read_profiles(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    df = _csv(spark, path, schemas.PROFILES)
    return check_unique(df, "userid") if check else df


def read_behaviors(spark: SparkSession, path: str, columns: Sequence[str] = ("user", "time_stamp", "btag", "cate", "brand")) -> DataFrame:
    """Behaviours from parquet; only the named columns are read."""
    return spark.read.schema(schemas.BEHAVIORS).parquet(path).select(*columns)


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """A built sample; CSV needs its schema."""
    if format == "csv":
        if schema is None:
            raise ValueError("a CSV table is read with its schema")
        return _csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(format).load(path)
