"""Substring deduplication by level-wise doubling of repeated word windows.

Level one takes windows of `base` words, thinned to the smallest hash of every run of windows that a window of twice the size
holds, so that each window of the next level holds a thinned one whatever document it stands in. Windows that more than one
document has survive; only around survivors are windows of twice the length formed, and so on until the wanted length is
reached or nothing survives. Each document sends a window's hash once, however often it repeats inside, counts are combined
before they are shuffled, and the join that hands a verdict back to the documents is an inner equi-join that AQE may split.

Edge cases: null text has no words and is kept as empty text; texts under `words` words lose nothing; a row whose doc_id is
null neither loses words nor makes others lose them; rows that share a doc_id never remove each other's words; equal windows
inside one document alone are kept; input columns besides doc_id and text are ignored unless `keep_columns` is set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, row_of, signed, steps, text_bytes, window_hashes, word_hashes, word_spans

WORDS = 50

#: A window's hash is 64 bits and 31 more, so that chance meetings stay away at any corpus size.
_WINDOWS = "hash long, check int, doc_id long"


def _words(batch: pa.RecordBatch):
    data, at = text_bytes(batch.column("text"))
    starts, ends, first = word_spans(data, at)
    return word_hashes(data, starts, ends), first


def _distinct(ids: np.ndarray, rows: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> pa.RecordBatch:
    """One output row for each row and hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes, checks = rows[order], hashes[order], checks[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return pa.RecordBatch.from_arrays([pa.array(signed(hashes[new])), pa.array(checks[new]), pa.array(ids[rows[new]])], ["hash", "check", "doc_id"])


def _check(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    return (window_hashes(words, first, size, seed=1)[0] >> np.uint64(33)).astype(np.int32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _thinned(size: int):
    """Emits, for each document, the smallest hash of every size + 1 successive windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, first = _words(batch)
            hashes, at = window_hashes(words, first, size)
            if len(at) <= size:
                continue
            smallest = _sliding_min(hashes, size + 1)
            whole = np.flatnonzero(at[size:] - at[:-size] == size)
            rows, smallest = row_of(first, at[whole]), smallest[whole]
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (smallest[1:] != smallest[:-1])
            rows, smallest = rows[new], smallest[new]
            yield _distinct(batch.column("doc_id").to_numpy(zero_copy_only=False), rows, smallest, np.zeros(len(rows), np.int32))

    return run


def _member(rows: np.ndarray, hashes: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each hash is in its own row's list."""
    sizes = np.diff(lists.offsets.to_numpy())
    told = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    key = lambda r, h: mix(h + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.isin(key(rows, hashes), key(np.repeat(np.arange(len(lists)), sizes), told))


def _extended(size: int, thinned: bool):
    """Emits windows of twice the size that hold surviving windows: any for a thinned level, else both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            batch = batch.filter(batch.column("alive").is_valid())
            if not batch.num_rows:
                continue
            words, first = _words(batch)
            hashes, at = window_hashes(words, first, size)
            alive = np.zeros(len(words) + size + 1, np.int32)
            alive[at] = _member(row_of(first, at), hashes, batch.column("alive").fill_null([]))
            longer, start = window_hashes(words, first, 2 * size)
            if thinned:
                upto = np.concatenate([[0], np.cumsum(alive)])
                found = upto[start + size + 1] > upto[start]
            else:
                found = (alive[start] & alive[start + size]) > 0
            if found.any():
                yield _distinct(batch.column("doc_id").to_numpy(zero_copy_only=False), row_of(first, start[found]), longer[found], _check(words, first, 2 * size)[found])

    return run


def _shared(windows: DataFrame) -> DataFrame:
    return windows.groupBy("hash", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")


def _survivors(windows: DataFrame, later_only: bool = False) -> DataFrame:
    """doc_id and the list of its windows that other documents have too, or that a smaller doc_id has."""
    found = windows.join(_shared(windows), ["hash", "check"])
    if later_only:
        found = found.where("doc_id > lo")
    return found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("hash").alias("alive"))


def _texts(docs: DataFrame) -> DataFrame:
    """Both joins on doc_id read the texts from this one plan, so that they are shuffled once."""
    return docs.select("doc_id", "text")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key and copy: whether a smaller doc_id has the row's whole text."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    return keyed.join(first, "key", "left").select("doc_id", "key", F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False)).alias("copy"))


def copies(docs: DataFrame) -> DataFrame:
    """_copy and _key: ids and text keys of documents whose whole text a smaller doc_id has. All their words go, without search."""
    return _marked(docs).where("copy").select(F.col("doc_id").alias("_copy"), F.col("key").alias("_key")).distinct()


def only_copies(docs: DataFrame) -> DataFrame:
    """_copy: ids of which every text is a whole copy. All their windows start in a smaller doc_id, so no search is needed."""
    return _marked(docs).groupBy(F.col("doc_id").alias("_copy")).agg(F.bool_and("copy").alias("_all")).where("_all").select("_copy")


def _first_level(docs: DataFrame, base: int, dropped: DataFrame) -> DataFrame:
    """Survivors of the thinned level among documents that are not whole copies."""
    sent = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_thinned(base), _WINDOWS)
    found = sent.join(_shared(sent), ["hash", "check"]).select("hash", "check", "doc_id")
    return _survivors(found.join(dropped, found.doc_id == dropped._copy, "left_anti"))


def _longer(docs: DataFrame, alive: DataFrame, size: int, base: int) -> DataFrame:
    texts = _texts(docs)
    return texts.join(alive, texts.doc_id == alive._id, "left").select("doc_id", "text", "alive").mapInArrow(_extended(size, size == base), _WINDOWS)


def repeated_windows(docs: DataFrame, words: int, dropped: DataFrame) -> DataFrame:
    """_id and alive: for each document, but for the whole copies `dropped`, the hashes of its windows of `words` words that
    also start in a smaller doc_id. `dropped` holds ids all of whose texts are copies."""
    base = words
    while base % 2 == 0 and base > 24:
        base //= 2
    if base == words:
        raise ValueError(f"words must be even and over 24, to be reached by doubling; it is {words}")
    alive, size = _first_level(docs, base, dropped), base
    while size < words:
        found = _longer(docs, alive, size, base)
        size *= 2
        alive = _survivors(found, later_only=size == words)
    return alive


def longest_levels(docs: DataFrame, base: int = 25) -> DataFrame:
    """level_words, n_windows, n_documents of every level until nothing survives: how long the corpus's repeats are."""
    spark, size, levels = docs.sparkSession, base, []
    alive = _first_level(docs, base, only_copies(docs))
    while True:
        alive = cut(alive)
        n, holders = alive.agg(F.coalesce(F.sum(F.size("alive")), F.lit(0)), F.count("*")).first()
        if not holders:
            return spark.createDataFrame(levels, "level_words long, n_windows long, n_documents long")
        levels.append((size, n, holders))
        alive = _survivors(_longer(docs, alive, size, base))
        size *= 2


def _apply(words: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashed, first = _words(batch)
            hashes, at = window_hashes(hashed, first, words)
            gone = np.zeros(len(hashed) + 1, np.int32)
            hit = at[_member(row_of(first, at), hashes, batch.column("alive").fill_null([]))] if len(at) else at
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + words, -1)
            copy = batch.column("_copy").is_valid().to_numpy(zero_copy_only=False) & (np.diff(first) >= words)
            covered = np.cumsum(gone) > 0
            covered[: len(hashed)] |= np.repeat(copy, np.diff(first))
            lost = np.concatenate([[0], np.cumsum(covered[: len(hashed)])])
            removed = lost[first[1:]] - lost[first[:-1]]
            kept = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = (text or "").encode().split()
                if removed[i]:
                    parts = compress(parts, ~covered[first[i] : first[i + 1]])
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every document without the words that a window of `words` words covers whose
    sequence also starts in a document with a smaller doc_id. Kept words are joined by one blank."""
    rows = _texts(docs)
    told = _told(docs, rows, words).select("doc_id", "text", "alive", "_copy")
    return told.mapInArrow(_apply(words, ["doc_id"]), "doc_id long, n_words long, n_removed long, kept_text string")


def _told(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    dropped = copies(docs)
    dead = repeated_windows(docs, words, only_copies(docs))
    same = dropped._key.contains(F.md5(rows.text.cast("binary")))  # no second join key, for which the texts would be shuffled again
    return rows.join(dead, rows.doc_id == dead._id, "left").join(dropped, (rows.doc_id == dropped._copy) & same, "left")


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The same rows and columns; a text that lost words is its kept words joined by one blank, others are untouched."""
    others = {f"_c{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for n, c in others.items()))
    names = rows.columns
    joined = _told(docs, rows, words).select(*names, "alive", "_copy")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = joined.mapInArrow(_apply(words, names), f"{kind}, n_words long, n_removed long, kept_text string")
    lost = F.col("n_removed") > 0
    told = {c: F.col(n) for n, c in others.items()} | {"doc_id": F.col("doc_id"), "text": F.when(lost, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in told:
        told["n_chars"] = F.when(lost, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(told["n_chars"])
    return out.select(*(told[c].alias(c) for c in docs.columns))
