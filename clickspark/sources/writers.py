"""Writers of samples and of the prepared behaviour log."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sample(df: DataFrame, path: str, format: str = "parquet", partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Writes a sample as parquet, partitioned if asked, or as CSV with a header and without an index column."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(format).save(path)


def content_key(df: DataFrame) -> str:
    """A key of a table's rows that does not depend on their order."""
    row = F.xxhash64(*df.columns)
    n, a, b = df.agg(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    return f"{n:x}-{(a or 0) & (1 << 64) - 1:x}-{b or 0:x}"


def input_key(df: DataFrame) -> str:
    """A key of what a table is made of: its plan and schema, and name, size and time of every file that it reads, from a listing.
    A table that reads no files is told by its rows."""
    files = df.inputFiles()
    if not files:
        return content_key(df)
    listed = df.sparkSession.read.format("binaryFile").load(sorted(set(files))).select("path", "length", "modificationTime")
    told = hashlib.sha256(f"{df.semanticHash()} {df.schema.simpleString()} {content_key(listed)}".encode())
    return told.hexdigest()[:24]


def materialize_behaviors(log: DataFrame, users: DataFrame, path: str, user: str = "user", time: str = "time_stamp", btag: str | None = "pv", buckets: int | None = None) -> DataFrame:
    """The log of the given users with one kind of behaviour as a table in buckets by user, sorted by user and time, written once.
    Joins, windows and groups by user read it without a shuffle where the other side comes in as many parts (by default as many
    as the session shuffles into); see `buckets` of `sequences.asof_history`.

    The folder is keyed by `input_key` of both inputs, so that other inputs never find an older result; inputs must not depend on
    anything but files and their plan, such as the present time. A mark is written after the rows; without it what stands there
    is taken for a write that did not end, and is written again."""
    spark = log.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = hashlib.sha256(f"{input_key(users.select(user))} {input_key(log)} {user} {time} {btag} {buckets}".encode()).hexdigest()[:32]
    folder, name = f"{path}/{told}", f"prepared_log_{told}"
    try:
        spark.read.schema("done boolean").parquet(f"{folder}/done").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.sql(f"drop table if exists {name}")
        kept = log if btag is None else log.where(F.col("btag") == btag)
        kept = kept.join(users.select(user).distinct(), user, "left_semi").select(*log.columns).repartition(buckets, user)
        kept.write.bucketBy(buckets, user).sortBy(user, time).option("path", f"{folder}/rows").mode("overwrite").saveAsTable(name)
        spark.createDataFrame([(True,)], "done boolean").write.mode("overwrite").parquet(f"{folder}/done")
    if not spark.catalog.tableExists(name):  # written by another session
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{user}`) sorted by (`{user}`, `{time}`) into {buckets} buckets location '{folder}/rows'")
    return spark.table(name)
