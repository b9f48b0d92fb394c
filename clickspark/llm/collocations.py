"""Collocations by dynamic phrase counting: lengths are interleaved in cyclic scans over shards of the corpus.

Documents are dealt into shards, written once. Each step scans one shard, in turn, and counts at once words and phrases of
several lengths. A phrase becomes active at the end of the step in which the later of its two subphrases, all words but the
last and all words but the first, reached the threshold; it is counted for one full cycle of shards from there on, so common
phrases are long under way while rare words are still being counted. The scans end when no phrase is under way.

Which subphrases have reached the threshold, and when, is told to all tasks by a table of fixed size: one byte, the step, for
each of 2^24 hashes. Phrases that meet in a byte take the earlier step, which is set once and never changes, but no phrase
counts as reached before it was active itself; phrases may then be counted without need, but always for one full cycle.
Counting goes by 48-bit hashes, packed and merged by ranges of hashes, and stops at the threshold: what counts together by
chance makes a phrase pass too easily, never fail. A last scan counts the phrases that passed by their texts, so what is
returned depends on no hash table.

Edge cases: null text counts as empty; a null language is `und`; documents count each, also repeated ones and those without an
id; empty pieces have no words; words may be of any length and of any characters; a language without a candidate returns
nothing; other input columns are ignored; an empty table gives no rows. Within one block of texts, occurrences are taken for
the same phrase if their 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, mix, steps, text_bytes, word_hashes, word_spans, written

#: Shards of the cycle, longest phrase, and occurrences that a phrase needs.
SHARDS, LONGEST, LEAST = 4, 4, 30

#: Occurrences of a longer phrase, in hundredths of a shorter one's, from which the shorter is dropped; phrases of a language.
COVERED, FIRST = 80, 2000

#: Text bytes of a block in a task of the last scan (the others take a third), of a slab whose words are hashed at once, and of a
#: range of hashes; ranges are powers of two within these ends.
BLOCK_BYTES, SLAB_BYTES, RANGE_BYTES, LEAST_BITS, MOST_BITS = 3 << 20, 256 << 10, 32 << 20, 4, 20

#: Text bytes that a task reads at least where there are more tasks than the session runs at once, and counts of phrases that it
#: holds before it adds them up, and sends them on if this leaves more than three quarters.
TASK_BYTES, TASK_KEYS = 64 << 20, 2_000_000

#: Bits of the byte table's places, and the byte of a phrase that has not reached the threshold.
SLOT_BITS, NEVER = 24, 255

#: Bytes between pieces, and bytes between words of a piece.
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
_IS_GAP = _IS_BREAK.copy()
_IS_GAP[list(_SPACES)] = True

_PACKED = "range int, low binary, high binary, meta binary, hits binary"


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, slab by slab: hashing takes some 50 bytes for each byte of text, which a whole block has no room for."""
    cuts = np.searchsorted(starts, np.arange(0, len(data) + SLAB_BYTES, SLAB_BYTES))
    out = np.empty(len(starts), np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            out[a:b] = word_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], lower=True)
    return out


class Block:
    """The words of a block of texts."""

    def __init__(self, batch: pa.RecordBatch):
        data, at = text_bytes(batch.column("text"))
        self.data, self.at = data, at
        self.starts, self.ends, first = word_spans(data, at, _IS_GAP)
        self.first = first
        tongue = mix(batch.column("tongue").to_numpy(zero_copy_only=False).view(np.uint64))
        self.hashes = mix(_hashed(data, self.starts, self.ends) ^ np.repeat(tongue, np.diff(first)))
        piece = np.cumsum(_IS_BREAK[data], dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        self.joined = piece[1:] == piece[:-1]
        inner = first[1:-1]
        self.joined[inner[(inner > 0) & (inner < len(piece))] - 1] = False

    def phrases(self, reached: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: first words, hashes, the step in which the phrase became active, and the step in which it reached
        the threshold, of all phrases whose subphrases have reached it."""
        own, at, shift = self.hashes, np.arange(len(self.hashes)), np.uint64(65 - len(reached).bit_length())
        step = reached[own >> shift]
        yield 1, at, own, np.zeros(len(own), np.uint8), step
        for k in range(2, LONGEST + 1):
            by_word = np.full(len(self.hashes) + 1, NEVER, np.uint8)
            by_word[at] = step
            both = np.maximum(by_word[:-1], by_word[1:])
            if k == 2:
                both[:-1][~self.joined] = NEVER
            taken = np.flatnonzero(both[at] < NEVER)
            at, active = at[taken], both[at[taken]]
            own = mix((own[taken] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) ^ self.hashes[at + k - 1])
            step = np.maximum(reached[own >> shift], active)  # the byte may be another phrase's, earlier than this one's start
            yield k, at, own, active, step

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """Phrases of k words as texts, lower case and joined by single blanks."""
        if not hasattr(self, "compact"):
            solid = ~_IS_GAP[self.data]
            kept = solid.copy()
            kept[1:] |= solid[:-1]
            self.compact = np.where(solid, _LOWER[self.data], np.uint8(32))[kept]
            place = np.cumsum(kept) - 1
            self.begin, self.stop = place[self.starts], place[self.ends - 1] + 1
        begin, sizes = self.begin[at], self.stop[at + k - 1] - self.begin[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        index = np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(self.compact[index].tobytes())).cast(pa.string())


def _pack(counts: np.ndarray, bits: int) -> list[tuple]:
    """Sorted counts (48 bits of hash, 8 of meta, 8 of hits) by range of hashes."""
    number = (counts >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(counts)]]) if len(counts) else []
    low, high, meta, hits = ((counts >> np.uint64(at)).astype(kind) for at, kind in ((16, "<u4"), (48, "<u2"), (8, np.uint8), (0, np.uint8)))
    return [(int(number[a]), *(x[a:b].tobytes() for x in (low, high, meta, hits))) for a, b in zip(cuts[:-1], cuts[1:])]


def _unpack(table: pa.Table) -> np.ndarray:
    out = np.zeros(sum(map(len, table.column("meta").to_pylist())), np.uint64)
    for c, kind, at in (("low", "<u4", 16), ("high", "<u2", 48), ("meta", np.uint8, 8), ("hits", np.uint8, 0)):
        out |= np.frombuffer(b"".join(table.column(c).to_pylist()), kind).astype(np.uint64) << np.uint64(at)
    return out


def _added(counts: np.ndarray, most: int) -> np.ndarray:
    """Counts of distinct hashes and metas in order, with their hits up to `most`. Sorts the given ones in place: as one number
    each they need no second array of places."""
    if not len(counts):
        return counts
    counts.sort()
    keys = counts >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[first] << np.uint64(8)
    counts &= np.uint64(255)
    return keys | np.minimum(np.add.reduceat(counts, first), np.uint64(most))


def _gathered(rows: DataFrame, size: int) -> DataFrame:
    """The rows in fewer tasks, if these have little to read, so that more is added up before it is sent."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return rows.coalesce(n)


def _counted(shard: DataFrame, reached, step: int, bits: int) -> DataFrame:
    """Packed counts of all phrases that are under way in this step. The meta byte holds the step from which a phrase counts, and
    its length."""

    def packed(counts: np.ndarray) -> pa.RecordBatch:
        rows = _pack(counts, bits)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], ["range", "low", "high", "meta", "hits"])

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        block, found = Block(batch), []
        for k, _, own, active, _ in block.phrases(reached.value):
            now = active + SHARDS > step
            found.append((own[now] >> np.uint64(16)) << np.uint64(8) | active[now].astype(np.uint64) << np.uint64(2) | np.uint64(k - 1))
        del block
        found = np.concatenate(found)
        found.sort()
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return found[first] << np.uint64(8) | np.minimum(np.diff(np.concatenate([first, [len(found)]])), 255).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in steps(batches, most=BLOCK_BYTES // 3):
            held.append(counts(batch))
            n += len(held[-1])
            if n > TASK_KEYS:
                held = [_added(np.concatenate(held), 255)]
                n = len(held[0])
                if n > TASK_KEYS * 3 // 4:  # too little room until the next time
                    yield packed(held.pop())
                    n = 0
        if held:
            yield packed(_added(np.concatenate(held), 255))

    return shard.mapInArrow(run, _PACKED)


def _merged(counted: DataFrame, step: int, bits: int) -> DataFrame:
    """Running counts of a range, and bitmaps of the hashes that have reached the threshold: of phrases that can still grow by a
    word, and of the longest."""
    places = 1 << (SLOT_BITS - bits)

    def run(table: pa.Table) -> pa.Table:
        counts = _added(_unpack(table), LEAST)
        own = (counts >> np.uint64(64 - SLOT_BITS)) & np.uint64(places - 1)
        longest = (counts >> np.uint64(8) & np.uint64(3)) == LONGEST - 1
        frequent = (counts & np.uint64(255)) >= LEAST
        maps = []
        for of in (~longest, longest):
            marks = np.zeros(places, bool)
            marks[own[of & frequent]] = True
            maps.append(np.packbits(marks).tobytes())
        going = (counts >> np.uint64(10) & np.uint64(63)).astype(np.int64) + SHARDS > step + 1
        rows = _pack(counts[going], bits) or [(table.column("range")[0].as_py(), b"", b"", b"", b"")]
        names = ["range", "low", "high", "meta", "hits", "growing", "longest"]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)), pa.array([maps[0]], pa.binary()), pa.array([maps[1]], pa.binary())], names)

    return counted.groupBy("range").applyInArrow(run, f"{_PACKED}, growing binary, longest binary")


def reached_table(dealt: DataFrame, size: int) -> np.ndarray:
    """For each place of the byte table the step after which a phrase of that place had reached the threshold, by cyclic scans
    over the shards. Two bitmaps of 2^24 bits reach the driver a step, in ranges, and the table of 2^24 bytes is broadcast."""
    sc = dealt.sparkSession.sparkContext
    bits = min(max(LEAST_BITS, int(size // RANGE_BYTES).bit_length()), MOST_BITS)
    table = np.full(1 << SLOT_BITS, NEVER, np.uint8)
    running, last, step = None, 0, 0
    while size and step < last + SHARDS:
        told = sc.broadcast(table)
        shard = _gathered(dealt.where(F.col("shard") == step % SHARDS).select("tongue", "text"), size // SHARDS)
        counted = _counted(shard, told, step, bits)
        both = counted if running is None else counted.unionByName(running)
        merged = written(_merged(both, step, bits))
        for row in merged.select("range", "growing", "longest").collect():
            part = table[row["range"] << (SLOT_BITS - bits) : (row["range"] + 1) << (SLOT_BITS - bits)]
            for grows, marks in ((True, row["growing"]), (False, row["longest"])):
                marked = np.unpackbits(np.frombuffer(marks, np.uint8)) > 0
                part[marked & (part == NEVER)] = step + 1
                if grows:
                    last = max(last, int(part.max(initial=0, where=marked)))
        running = merged.select("range", "low", "high", "meta", "hits").where("low != x''")
        told.destroy()
        step += 1
    return table


def _named(dealt: DataFrame, reached) -> DataFrame:
    """lang, k, phrase and hits of all phrases that passed, block by block; with k 0 the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=BLOCK_BYTES):
            block = Block(batch)
            langs = batch.column("lang")
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs), pa.string()), pa.array(np.diff(block.first).astype(np.int64))], ["lang", "k", "phrase", "hits"])
            for k, at, own, _, step in block.phrases(reached.value):
                at, own = at[step < NEVER], own[step < NEVER]
                if not len(at):
                    continue
                order = np.argsort(own, kind="stable")
                own = own[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                hits, at = np.diff(np.concatenate([first, [len(own)]])), at[order[first]]
                row = np.searchsorted(block.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(row)), pa.array(np.full(len(at), k, np.int32)), block.texts(at, k), pa.array(hits.astype(np.int64))], ["lang", "k", "phrase", "hits"])

    return dealt.mapInArrow(run, "lang string, k int, phrase string, hits long")


def frequent_phrases(docs: DataFrame) -> DataFrame:
    """lang, k, phrase and f of all phrases of 1 to `LONGEST` words that occur at least `LEAST` times in a language, and with k 0
    the number of words of each language."""
    lang, text = F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit(""))
    dealt = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("tongue"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.pmod(F.xxhash64("doc_id", text), F.lit(SHARDS)).cast("int").alias("shard"))
    dealt = written(dealt, "shard")
    size = dealt.agg(F.sum("n_bytes")).first()[0] or 0
    told = dealt.sparkSession.sparkContext.broadcast(reached_table(dealt, size))
    found = _named(_gathered(dealt.select("lang", "tongue", "text"), size), told)
    return found.groupBy("lang", "k", "phrase").agg(F.sum("hits").alias("f")).where((F.col("f") >= LEAST) | (F.col("k") == 0))


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    known = written(frequent_phrases(docs))
    whole = known.where("k > 0").select("lang", "phrase", "f")
    asked = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = asked.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.col("words"), F.lit(1), F.col("cut")).alias("left"), _part(F.col("words"), F.col("cut") + 1, F.size("words")).alias("right"))
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(whole.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    pieces = F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part(F.col("words"), i, n)))
    inner = asked.where("k > 2").select("lang", F.explode(F.array_distinct(F.flatten(pieces))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED
    kept = least.join(inner, ["lang", "phrase"], "left").where(F.coalesce(~covered, F.lit(True)))

    w = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    n = known.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))
