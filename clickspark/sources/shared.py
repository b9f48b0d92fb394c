"""Tables that a job writes for itself in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a local session may do without spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def own_folder(spark: SparkSession) -> str:
    """A folder that nothing else writes to."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, computed once and written as a table in a folder of their own, by the values of some columns if asked. What
    is read from it does not depend on executors that are lost later."""
    path = own_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
