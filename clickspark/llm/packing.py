"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

Only the number of pieces of each length matters for the choice of bins, and there are at most `capacity` lengths, so the
choice is made on that histogram: the longest piece left opens a bin, a subset-sum over a bitset of the lengths still
available finds the fullest combination that fits beside it, and the combination is taken as often as the pieces last. Spark
then ranks the pieces of each length, in salted groups, and a bounded table turns length and rank into sequence and place.

Edge cases: a null or empty text is its end token alone; a text of more than `capacity` tokens is cut into pieces of
`capacity`, the first of which may be shorter; rows that repeat are packed each on its own, so that they share doc_id and
piece; a null doc_id is kept; an empty table gives no rows; white space may run to any length; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, steps

CAPACITY, END = 1024, 2

#: Pieces of one length that are ranked in one group.
GROUP_ROWS = 200_000

#: White space from which a run is handed over as one piece; the library's matcher overflows on runs near a million.
LONG_RUN = 100_000

_RUN = regex.compile(rf"(?<!\s)\s{{{LONG_RUN},}}+")
_CODERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def _coder(path: str, pattern: str = bpe.PATTERN) -> tiktoken.Encoding:
    """The vocabulary in tiktoken, which gives the ids of tokenizers in less time; its added tokens are put back by `_ids`."""
    if (path, pattern) not in _CODERS:
        own = bpe.vocabulary(path)
        ranks = {t: i for i, t in enumerate(own.tokens) if i not in own.added.values()}
        _CODERS[path, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path, pattern]


def _ordinary(path: str, text: str) -> list[int]:
    """Ids of a text without added tokens. A long run of white space is one piece but for its last character, which goes with
    what follows it."""
    coder, out, at = _coder(path), [], 0
    if len(text) >= LONG_RUN:
        for m in _RUN.finditer(text):
            upto = m.end() - (m.end() < len(text))
            out += coder.encode_ordinary(text[at : m.start()]) + _coder(path, r"(?s:.+)").encode_ordinary(text[m.start() : upto])
            at = upto
    return out + coder.encode_ordinary(text[at:])


def _ids(path: str, text: str) -> list[int]:
    own = bpe.vocabulary(path)
    if own.split_added is None or not any(a in text for a in own.added):
        return _ordinary(path, text)
    out, at = [], 0
    for m in own.split_added.finditer(text):
        out += [*_ordinary(path, text[at : m.start()]), own.added[m[0]]]
        at = m.end()
    return out + _ordinary(path, text[at:])


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with `with_ids` the ids themselves (little-endian 32-bit)."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows, piece, start, length, crc, raw = [], [], [], [], [], []
            for row, text in enumerate(pc.fill_null(batch.column("text"), "").to_pylist()):
                ids = _ids(path, text)
                ids.append(END)
                data, n = memoryview(np.array(ids, "<u4").tobytes()), len(ids)
                at, k = 0, 0
                while at < n:
                    upto = at + ((n - at) % capacity or capacity)
                    rows.append(row), piece.append(k), start.append(at), length.append(upto - at)
                    part = data[4 * at : 4 * upto]
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(bytes(part))
                    at, k = upto, k + 1
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES + ", ids binary" * with_ids)


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, none more often than it is available, whose sum is the largest that is at most `room`; long ones preferred."""
    reach, seen = 1, []
    mask = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        for _ in range(min(int(counts[length]), room // length)):
            seen.append((length, reach))
            reach |= (reach << length) & mask
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(seen):
        if not before >> total & 1:
            out.append(length)
            total -= length
    return out


def choose(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, last rank + 1, first sequence, offset) for all pieces counted, and the number of sequences."""
    left, used, rows, sequences = counts.astype(np.int64).copy(), np.zeros_like(counts, dtype=np.int64), [], 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        combination = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        lengths, copies = np.unique(combination, return_counts=True)
        times = int((left[lengths] // copies).min())
        offset = 0
        for length in combination:
            rows.append((length, int(used[length]), int(used[length]) + times, sequences, offset))
            used[length] += times
            left[length] -= times
            offset += length
        sequences += times
    return rows, sequences


def _placed(rows: list[tuple[int, int, int, int, int]], capacity: int):
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    key = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            held = batch.column("held")
            yield pa.RecordBatch.from_arrays([*held.flatten(), pa.array(sequence), pa.array(table[at, 4])], [*(f.name for f in held.type), "sequence_id", "offset"])

    return run


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (any table with doc_id, piece, length) with sequence_id, and offset in that sequence; columns that have these two
    names already are replaced. All columns travel in one, so that no name of theirs meets one used here."""
    found = cut(found.drop("sequence_id", "offset"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    rows, _ = choose(counts, capacity)
    salts = max(64, int(counts.sum()) // GROUP_ROWS)
    salted = found.select(F.struct(*(F.col(f"`{c}`") for c in found.columns)).alias("held"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    inner = Window.partitionBy("length", "salt").orderBy("held.doc_id", "held.piece")
    ranked = salted.withColumn("inner", F.row_number().over(inner) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("held", F.col("length").cast("long").alias("length"), (F.col("before") + F.col("inner")).cast("long").alias("rank"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(_placed(rows, capacity), f"{kind}, sequence_id long, offset long")
