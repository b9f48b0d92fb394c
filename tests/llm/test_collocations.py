"""Operator 13 against plain counting."""

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clickspark.llm import collocations, queries

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _counted(rows):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(_LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][tuple(ws[i : i + k])] += 1
    return f


def _brute(rows, least=30, first=2000):
    out = []
    for lang, f in _counted(rows).items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        n = sum(a for p, a in f.items() if len(p) == 1)
        kept = []
        for p, a in known.items():
            score, k, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items()):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def _mined(spark, rows, **more):
    table = spark.createDataFrame([(i % 7 or None, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    return sorted(map(tuple, collocations.collocations(table, **more).collect()))


def _corpus(seed, n=700):
    rng = np.random.default_rng(seed)
    words = ["The", "of", "a\x1cb", "É", "日本", "x" * 300, *(f"w{i}" for i in range(14))]
    share = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        told = [words[k] for k in rng.choice(len(words), int(rng.integers(0, 60)), p=share / share.sum())]
        gaps = [" ", "  ", "\t", ", ", ".", "\n", " ", " ", "\x0b"]
        text = "".join(w + gaps[int(rng.integers(len(gaps)))] for w in told)
        rows.append((["en", "de", None, "und"][int(rng.integers(4))], text if i % 11 else "New York City council! new YORK city, rare pair"))
    return [*rows, ("fr", None), (None, ""), ("fr", " \t.\n"), ("en", "again and again " * 200)]


@pytest.mark.parametrize(("shards", "slots", "block"), [(4, 24, 1 << 20), (2, 8, 500), (3, 12, 2000), (1, 24, 1 << 20)])
def test_against_plain_counting(spark, monkeypatch, shards, slots, block):
    """Also where nearly all phrases meet in the byte table, and with blocks of a few texts."""
    monkeypatch.setattr(collocations, "SHARDS", shards)
    monkeypatch.setattr(collocations, "SLOT_BITS", slots)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rows = _corpus(slots)
    found = _mined(spark, rows)
    assert found == _brute(rows) and len(found) > 20


def test_first_of_each_language(spark):
    rows = _corpus(5)
    found = _mined(spark, rows, first=3)
    assert found == _brute(rows, first=3) and {r[1] for r in found} == {1, 2, 3}


def test_longer_phrases_hide_shorter_ones(spark):
    """Four words that always stand together hide their parts; a pair that also stands alone stays."""
    rows = [("en", "zero one two three")] * 40 + [("en", "one two")] * 20 + [("en", "pad")] * 5
    assert _mined(spark, rows) == [("en", 1, "one two", 60, 60, 60, 205, 1_000_000), ("en", 2, "zero one two three", 40, 40, 40, 205, 1_000_000)]


def test_shards_activate_longer_phrases(spark):
    """A phrase that is rare until the last shard still has its full cycle."""
    rows = [("en", f"u{i} v{i} w{i} x{i}") for i in range(40) for _ in range(30)]
    assert [r[2] for r in _mined(spark, rows)] == sorted(f"u{i} v{i} w{i} x{i}" for i in range(40))


@pytest.mark.parametrize("slots", [8, 9, 10])
def test_full_cycle_where_phrases_meet_in_a_byte(spark, monkeypatch, slots):
    """Rare phrases whose bytes were set early by common words, before their own words had reached the threshold."""
    monkeypatch.setattr(collocations, "SLOT_BITS", slots)
    rows = [("en", f"c{i}. c{i}") for i in range(150) for _ in range(90)] + [("en", f"u{i} v{i} w{i} x{i}") for i in range(60) for _ in range(30)]
    assert _mined(spark, rows) == _brute(rows)


def test_empty_tables(spark, empty):
    assert collocations.collocations(empty).collect() == []
    assert _mined(spark, [("en", None), (None, "")]) == []


def test_odd_rows(odd, odd_rows):
    assert sorted(map(tuple, collocations.collocations(odd).collect())) == _brute([("en", t) for _, t in odd_rows])


def test_query(spark, small):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_collocations(spark, small).collect())) == _brute(rows)


def _text_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), 7, np.int64)), pa.array(texts)], ["tongue", "text"])


def _peak(run):
    """The most bytes that the arrays of a call take at once, without those of a first call that stay."""
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_takes_little_room():
    """A block of 3 MB once took 64 MB while its words were hashed."""
    batch = _text_batch(["some words of Text, and more. " * 35] * 3000)
    assert _peak(lambda: collocations.Block(batch)) < 15 * batch.nbytes


def test_counts_are_added_in_little_room():
    counts = np.random.default_rng(1).integers(0, 1 << 63, 1_000_000).astype(np.uint64)
    counts[1::2] = counts[::2]
    assert _peak(lambda: collocations._added(counts.copy(), 255)) < 6 * counts.nbytes


@pytest.mark.parametrize("slab", [1, 7, 64])
def test_words_over_the_ends_of_slabs(monkeypatch, slab):
    monkeypatch.setattr(collocations, "SLAB_BYTES", slab)
    batch = _text_batch(["", "a", "A long-word " + "x" * 200 + " end", "  ", "É 日本\tb. c"])
    block = collocations.Block(batch)
    whole = collocations.word_hashes(block.data, block.starts, block.ends, lower=True)
    assert (collocations._hashed(block.data, block.starts, block.ends) == whole).all()


def test_counts_packed_and_added():
    counts = np.array([5 << 60 | 9 << 8 | 200, 3 << 8 | 20, 5 << 60 | 9 << 8 | 100, 3 << 8 | 5], np.uint64)
    added = collocations._added(counts, 255)
    assert added.tolist() == [3 << 8 | 25, 5 << 60 | 9 << 8 | 255]
    rows = collocations._pack(added, 4)
    assert [r[0] for r in rows] == [0, 5]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(["range", "low", "high", "meta", "hits"])})
    assert collocations._unpack(table).tolist() == added.tolist()
    assert collocations._pack(added[:0], 4) == [] and not len(collocations._added(added[:0], 255))


def test_counts_sent_on_early(spark, monkeypatch):
    """Also where a task has room for a few counts only."""
    monkeypatch.setattr(collocations, "TASK_KEYS", 40)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 3000)
    rows = _corpus(5, 300)
    assert _mined(spark, rows) == _brute(rows)
