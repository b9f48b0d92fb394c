"""Byte-level BPE: a minimal acyclic transducer of frequent words, exact merging of all other words, and decoding.

The lexicon holds the corpus's most frequent words. It is compiled into an automaton that shares equal suffixes; numbers on
its arcs add up to a word's place in a flat table of ids. Executors memory-map the file. All words of a batch walk it at
once; words that it does not accept are merged pair by pair, lowest rank first, which gives the ids the vocabulary defines.

A text may be cut before any single blank that stands between two other characters, because no token spans such a place; the
pieces between cuts repeat, so each worker keeps a bounded table of the latest short ones.

Edge cases: null text counts as empty and has no ids; an added token's own string in a text is that token, as the library
reads it; texts may have any length; rows that repeat are encoded each on its own; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, steps

#: Words in the lexicon, bytes of the longest, the hash groups they are chosen from, and pieces in each of the two generations a
#: worker remembers.
LEXICON_WORDS, LEXICON_BYTES, GROUPS, REMEMBERED = 20_000, 64, 64, 150_000

#: Characters of the longest piece that is remembered, and bytes from which a word is merged rank by rank.
REMEMBERED_LENGTH, LONG_WORD = 64, 512

#: Fixed value: how the vocabulary's pre-tokenizer splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPLIT = regex.compile(PATTERN)
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_ODD = regex.compile(r"\s |  | \s|^ | $")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and added tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        symbols = _byte_symbols()
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        vocab = told["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = as_bytes(token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        made = np.zeros(len(self.tokens), np.int64)
        made[merged[::-1]] = np.arange(len(merged))[::-1]  # a token's first merge, 0 for single bytes
        parts = np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64).reshape(-1, 2)
        self.in_order = bool((made[parts].max(1, initial=0) <= np.arange(len(parts))).all())
        self.split_added = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], _NEVER), np.where(known, self.merged[at], 0)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian 32-bit: of all adjacent pairs in a word, the one of lowest rank, leftmost first,
        merges, until none can."""
        long = [i for i, w in enumerate(words) if len(w) >= LONG_WORD] if self.in_order else []
        if long:
            out = [b""] * len(words)
            short = sorted(set(range(len(words))).difference(long))
            for chosen, told in ((short, self.merge([words[i] for i in short])), (long, self._merge_long([words[i] for i in long]))):
                for i, ids in zip(chosen, told):
                    out[i] = ids
            return out
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        inner = word[1:] == word[:-1] if len(word) else np.zeros(0, bool)
        rank, into = np.full(len(ids), _NEVER), np.zeros(len(ids), np.int64)
        rank[:-1][inner], into[:-1][inner] = self._rank(ids[:-1][inner], ids[1:][inner])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank * (1 << 32) + np.arange(len(ids)), first)
            at = (best & 0xFFFFFFFF)[best < _NEVER * (1 << 32)]
            if len(at) < len(first):  # the words that cannot merge any more leave
                still = np.repeat(best < _NEVER * (1 << 32), np.diff(np.concatenate([first, [len(ids)]])))
                done.append((word[~still], ids[~still]))
                at = (np.cumsum(still) - 1)[at]
                ids, word, rank, into = ids[still], word[still], rank[still], into[still]
            if not len(at):
                break
            ids[at] = into[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            ids, word, rank, into = ids[keep], word[keep], rank[keep], into[keep]
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < len(ids))
                ok[ok] = word[left[ok]] == word[left[ok] + 1]
                rank[left[ok]], into[left[ok]] = self._rank(ids[left[ok]], ids[left[ok] + 1])
                rank[left[~ok & (left >= 0) & (left == at)]] = _NEVER
        word, ids = np.concatenate([w for w, _ in done] or [np.zeros(0, np.int64)]), np.concatenate([i for _, i in done] or [np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        raw, ends = ids[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, words: list[bytes]) -> list[bytes]:
        """The same for long words, rank after rank: a merge only makes pairs of higher rank, so all places of a rank merge
        together. Places wait in lists by rank; a place whose pair has changed meanwhile is passed over."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids, ends = self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(sizes)
        n = len(ids)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        after[ends - 1], before[ends - sizes] = n, -1
        rank, into = np.full(n, _NEVER), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            rank[places], into[places] = self._rank(ids[places], ids[after[places]])
            places = places[rank[places] < _NEVER]
            if not len(places):
                return
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            cuts = np.flatnonzero(np.diff(rank[places])) + 1
            for r, part in zip(rank[places[[0, *cuts]]].tolist(), np.split(places, cuts) if len(cuts) else [places]):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(np.flatnonzero(after < n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])  # the same token again and again: every other pair
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at], alive[gone], rank[gone] = into[at], False, _NEVER
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            rank[at] = _NEVER
            left = before[at]
            wait(np.unique(np.concatenate([left[left >= 0], inner])))
        kept = np.flatnonzero(alive)
        cuts = np.searchsorted(kept, ends[:-1])
        return [part.astype("<u4").tobytes() for part in np.split(ids[kept], cuts)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


_NEVER = np.int64(1 << 24)


class Transducer:
    """A minimal acyclic automaton from words to id lists, as arrays that can be memory-mapped."""

    NAMES = ("classes", "arcs", "outputs", "final", "ends", "ids")

    def __init__(self, classes, arcs, outputs, final, ends, ids):
        self.classes, self.arcs, self.outputs, self.final, self.ends, self.ids = classes, arcs, outputs, final, ends, ids

    @classmethod
    def build(cls, words: dict[bytes, bytes]) -> Transducer:
        """States are made in word order; when a branch ends, each of its states is replaced by an equal one if there is one."""
        table = sorted(w for w in words if w)
        nexts: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (state, byte, state below) of the word before

        def settle(upto: int) -> None:
            while len(path) > upto:
                state, byte, below = path.pop()
                same = known.setdefault((final[below], *sorted(nexts[below].items())), below)
                nexts[state][byte] = same

        before = b""
        for w in table:
            shared = len(os.path.commonprefix([before, w]))
            settle(shared)
            state = path[-1][2] if path else 0
            for byte in w[shared:]:
                nexts.append({})
                final.append(False)
                nexts[state][byte] = len(nexts) - 1
                path.append((state, byte, len(nexts) - 1))
                state = len(nexts) - 1
            final[state] = True
            before = w
        settle(0)
        counts: dict[int, int] = {}
        order, stack = [], [0]
        seen = set()
        while stack:  # children before parents
            s = stack.pop()
            if s < 0:
                order.append(~s)
            elif s not in seen:
                seen.add(s)
                stack.append(~s)
                stack.extend(nexts[s].values())
        for s in order:
            counts[s] = final[s] + sum(counts[t] for t in nexts[s].values())
        number = {s: i for i, s in enumerate(reversed(order))}  # the root is 0
        dead = len(order)
        used = sorted({b for w in table for b in w})
        classes = np.full(256, len(used), np.int32)
        classes[used] = np.arange(len(used))
        arcs = np.full((dead + 1, len(used) + 1), dead, np.int32)
        outputs = np.zeros((dead + 1, len(used) + 1), np.int32)
        ends = np.zeros(dead + 1, bool)
        for s, i in number.items():
            before_here = int(final[s])
            ends[i] = final[s]
            for byte in sorted(nexts[s]):
                t = nexts[s][byte]
                arcs[i, classes[byte]], outputs[i, classes[byte]] = number[t], before_here
                before_here += counts[t]
        lists = [words[w] for w in table]
        return cls(classes, arcs, outputs, ends, np.cumsum([0, *map(len, lists)]) // 4, np.frombuffer(b"".join(lists), "<u4"))

    @classmethod
    def load(cls, file: str) -> Transducer:
        """Maps a saved automaton into memory; all workers of a machine share its pages."""
        all_of_it = np.memmap(file, np.int32, "r")
        shapes, at, arrays = all_of_it[: 2 * len(cls.NAMES)].reshape(-1, 2).tolist(), 2 * len(cls.NAMES), []
        for rows, columns in shapes:
            n = rows * max(columns, 1)
            arrays.append(all_of_it[at : at + n].reshape((rows, columns) if columns else (rows,)))
            at += n
        return cls(*arrays)

    def save(self, file: str) -> None:
        arrays = [np.ascontiguousarray(a).astype("<u4").view(np.int32) for a in (getattr(self, n) for n in self.NAMES)]
        shapes = [(a.shape[0], a.shape[1] if a.ndim == 2 else 0) for a in arrays]
        with open(file, "wb") as f:
            f.write(np.array(shapes, np.int32).tobytes() + b"".join(a.tobytes() for a in arrays))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table, or -1; all words walk together, one byte a step."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.append(np.frombuffer(b"".join(words), np.uint8), 0)
        begin = np.cumsum(sizes) - sizes
        state, place, dead = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), len(self.arcs) - 1
        walking, step = np.flatnonzero(sizes > 0), 0
        while len(walking):
            c = self.classes[data[begin[walking] + step]]
            place[walking] += self.outputs[state[walking], c]
            state[walking] = self.arcs[state[walking], c]
            step += 1
            walking = walking[(sizes[walking] > step) & (state[walking] != dead)]
        return np.where((self.final[state] > 0) & (sizes > 0), place, -1)


class Encoder:
    """Texts to little-endian 32-bit ids, by a transducer and exact merging."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.vocabulary, self.transducer = vocabulary, transducer
        self.first: list[dict[str, bytes]] = [{}, {}]  # the present generation and the one before
        self.later: list[dict[str, bytes]] = [{}, {}]

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        at = self.transducer.find(raw)
        table, ends = self.transducer.ids.tobytes(), (4 * self.transducer.ends.astype(np.int64)).tolist()
        out = {words[i]: table[ends[k] : ends[k + 1]] for i, k in enumerate(at.tolist()) if k >= 0}
        rest = np.flatnonzero(at < 0).tolist()
        out.update(zip([words[i] for i in rest], self.vocabulary.merge([raw[i] for i in rest])))
        return out

    def _pieces(self, text: str) -> list[str]:
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def _remember(self, ages: list[dict[str, bytes]], pieces: set[str], lead: str) -> dict[str, bytes]:
        """Ids of all pieces, from either generation or encoded; a full generation becomes the one before. Long pieces are
        taken out again by `encode`."""
        if len(ages[0]) > REMEMBERED:
            ages[:] = [{}, ages[0]]
        into, before = ages
        new = []
        for p in pieces.difference(into):
            if (known := before.get(p)) is not None:
                into[p] = known
            else:
                new.append(p)
        if not new:
            return into
        single = [lead + p for p in new if p.isalpha()]
        others = [(p, _SPLIT.findall(lead + p)) for p in new if not p.isalpha()]
        words = self._of_words(list(set(single).union(*[ws for _, ws in others])))
        for p, ws in others:
            into[p] = b"".join([words[w] for w in ws])
        skip = len(lead)
        for w in single:
            into[w[skip:]] = words[w]
        return into

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        added = self.vocabulary.split_added
        if added is not None and any(a in t for t in texts for a in self.vocabulary.added):
            return [self._with_added(t) for t in texts]
        cut = [self._pieces(t) for t in texts]
        firsts = [c.pop(0) for c in cut]
        leading, following = set(firsts), set().union(*cut)
        first = self._remember(self.first, leading, "")
        later = self._remember(self.later, following, " ").__getitem__
        out = [first[f] + b"".join(map(later, c)) for f, c in zip(firsts, cut)]
        for ages, pieces in ((self.first, leading), (self.later, following)):
            for p in pieces:
                if len(p) > REMEMBERED_LENGTH:
                    ages[0].pop(p, None)
        return out

    def _with_added(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.vocabulary.split_added.finditer(text):
            out += [self.encode([text[at : m.start()]])[0], np.array([self.vocabulary.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.encode([text[at:]])[0]])


_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _encoder(path: str, lexicon: str) -> Encoder:
    if (path, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, lexicon] = Encoder(vocabulary(path), Transducer.load(SparkFiles.get(lexicon)))
    return _ENCODERS[path, lexicon]


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of at most `LEXICON_BYTES` bytes: of each of `GROUPS` hash groups the first n / GROUPS. At most n
    such words are collected, and each task keeps no more of a group than that. Longer words are merged like any unseen word."""
    words = docs.select(F.explode(F.split("text", BLANK_RUN)).alias("word")).where((F.col("word") != "") & (F.octet_length("word") <= LEXICON_BYTES))
    counted = words.groupBy("word").count().withColumn("group", F.pmod(F.xxhash64("word"), F.lit(GROUPS)))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("count"), "word"))
    return [r["word"] for r in counted.withColumn("place", place).where(F.col("place") <= max(1, n // GROUPS)).select("word").collect()]


_SENT: set[tuple[str, str]] = set()


def compile_lexicon(docs: DataFrame, path: str, n: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words, hands the file to all executors, once a lexicon, and returns its name."""
    own = vocabulary(path)
    pieces = sorted({p for w in frequent_words(docs, n) for p in _SPLIT.findall(" " + w)})
    name = "lexicon-" + hashlib.sha256("\0".join([path, *pieces]).encode()).hexdigest()[:16]
    sc = docs.sparkSession.sparkContext
    if (sc.applicationId, name) not in _SENT:
        raw = [p.encode() for p in pieces]
        file = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
        Transducer.build(dict(zip(raw, own.merge(raw)))).save(file)
        sc.addFile(file)
        _SENT.add((sc.applicationId, name))
    return name


def encode(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """doc_id and ids: all ids of a text as one binary of little-endian unsigned 32-bit integers. With `decoded` also text, what
    the ids stand for, read back from the ids where they were made."""
    path = path or default_path()
    lexicon = compile_lexicon(docs, path, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, lexicon)
        for batch in steps(batches, most=3 << 20):
            ids = encoder.encode(pc.fill_null(batch.column("text"), "").to_pylist())
            columns, names = [batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            if decoded:
                columns.append(pa.array([encoder.vocabulary.decode(np.frombuffer(i, "<u4")) for i in ids], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the ids stand for; added tokens are spelled out."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in steps(batches, "ids", 4 << 20):
            texts = [own.decode(np.frombuffer(i, "<u4")) for i in pc.fill_null(batch.column("ids"), b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
