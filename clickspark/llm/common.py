"""Helpers shared by the text operators: reading, lineage cuts, and vectorised hashing of words in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer single document is worked on alone.
STEP_BYTES = 1 << 20

#: ASCII white space: blank and \t \n \v \f \r. Everything else belongs to a word.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold`; a null id is in no fold, so it is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def one_text_each(rows: DataFrame) -> DataFrame:
    """One row for each doc_id, with its smallest text (null: empty) and its label, so that an id with many rows teaches once."""
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Only a local session may do without spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, written once as a compressed table in the shared folder, by the values of some columns if asked."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut again so that each holds at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            upto = max(at + 1, upto)
            yield batch.slice(at, upto - at)
            at = upto
    pa.default_memory_pool().release_unused()  # workers stay, and other stages need the room


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and where each row begins (one more entry than rows). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_OF_BYTES, _OF_WORDS = Powers(_BASE), Powers(_WORD_BASE)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, at: np.ndarray, blank: np.ndarray = _IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (one more entry than rows). `blank` tells which bytes
    belong to no word."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(blank[data], out=solid[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    inner = solid[1:]
    starts = np.flatnonzero(inner[:n] & (~solid[:n] | edge[:n]))
    ends = np.flatnonzero(inner[:n] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words, the same wherever a word stands."""
    up, down = _OF_BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words that lie within one row, and the word at which each starts."""
    n = len(words)
    up, down = _OF_WORDS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(words ^ np.uint64(seed)) if seed else words) * up[:n], out=total[1:])
    rows = np.diff(first)
    last = np.repeat(first[1:], rows) - size
    at = np.flatnonzero(np.arange(n) <= last)
    return mix((total[at + size] - total[at]) * down[at] + np.uint64(size)), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def row_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each word index."""
    return np.searchsorted(first, at, side="right") - 1


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
