"""Language-model scores from a weighted backoff automaton of up to three words.

States are histories: the empty one, every word seen in training (and the start of a text), and every pair of words from which
a kept trigram leaves. A state's arcs are the n-grams kept after it, with their log-probabilities; where no arc fits, the
failure arc leads to the history without its first word and adds the log of the weight left over. The empty history has an arc
for each word and one for all unseen words. Bigrams are kept from one occurrence on, trigrams from `LEAST_TRIGRAM` on. With
c(h) the occurrences of a history, K(h) its kept arcs and T(h) the sum of their counts, the discount D of an order gives

    weight(h) = (c(h) - T(h) + D K(h)) / c(h)        P(w | h) = (c(h w) - D) / c(h) + weight(h) P(w | h without first word)

so each state's probabilities add up to one. D takes from the smallest kept count r what its Good-Turing estimate loses,
r - (r + 1) n(r + 1) / n(r), from the training texts' own counts of counts. A text is read once from left to right: the state is
carried from word to word, and what arcs and failure arcs weigh is added up. All texts of a block walk together.

The automaton grows with the corpus and is never in one place. Documents are dealt into blocks. In three rounds, of words,
bigrams and trigrams, a block sends each of its distinct n-grams once, with its training count, to the shard that owns the
n-gram's history; shards add up and send each block what it asked for, totals of n-grams and of histories. A trigram is asked for
only if the occurrences of its two bigrams outside the block, added to its own in the block, are enough for it. With what it was told a block builds the automaton that its texts need. A
history that is too frequent for one shard is dealt into parts by its continuations; a block asks all parts for their totals.
What a shard or block holds is bounded by `BLOCK_BYTES` and `SHARD_BYTES`, whatever the size of the corpus or the frequency of a
word, and what is exchanged grows in proportion to the corpus.

Edge cases: null text counts as empty, whose only token is the end; an empty table gives no rows; rows that repeat are
counted and scored each (rows equal in both doc_id and text meet in one block); a null doc_id is a training row; with no training
row at all every word is unseen; other input columns are ignored. Words are compared by 64-bit hashes of their bytes, A-Z in
lower case, of which 26 bits more are kept than the number of bytes in the table has; histories likewise; the continuations of one
history by 32 bits more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix, steps, text_bytes, word_hashes, word_spans

FOLDS, HELD_OUT = 5, 1
ORDERS, LEAST_BIGRAM, LEAST_TRIGRAM = 3, 1, 2

#: Text in a block; text whose n-grams of each order one shard owns; occurrences of a history in one part of its continuations.
BLOCK_BYTES, SHARD_BYTES, PART_TOKENS = 7 << 20, (32 << 20, 8 << 20, 16 << 20), 100_000

#: Tokens that one lane of a traversal reads; the next lane of the text starts in the state that the tokens before lead to.
LANE = 512

_END, _START = np.uint64(0x6C62272E07BB0142), np.uint64(0x27D4EB2F165667C5)
_ODD = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))


# --- packing


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs, compressed."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    width = max((k + 1 for k in range(8) if raw[k].any()), default=1)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(raw[:width].tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    wide = np.zeros((8, n), np.uint8)
    wide[:width] = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n) if n else 0
    return np.ascontiguousarray(wide.T).view("<i8").ravel()


def _squeezed(keys: np.ndarray) -> bytes:
    """Sorted hashes as gaps."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _spread(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw).view(np.uint64), dtype=np.uint64)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that go to one block as one compressed value."""
    for batch in steps(batches, most=16 << 20):
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        sorted_rows, cuts = batch.select(["doc_id", "text", "train"]).take(pa.array(order)), np.flatnonzero(np.diff(block[order])) + 1
        parts = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, sorted_rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_batch(sorted_rows.slice(a, b - a))
            parts.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(block[order[[0, *cuts.tolist()]]]), pa.array(parts, pa.binary())], ["block", "texts"])


# --- a block


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with inverse and first places, in a fraction of its time: keys (not negative) and their places are sorted as one
    number each; where a key's low bits find no room beside the place, the few keys that then look alike are sorted again."""
    x = keys.astype(np.uint64)
    bits = np.uint64(max(1, len(x).bit_length()))
    low = np.uint64(max(0, int(x.max(initial=0)).bit_length() + int(bits) - 64))
    packed = np.sort((x >> low) << bits | np.arange(len(x), dtype=np.uint64))
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = x[at]
    if low:
        alike = np.flatnonzero((packed[1:] >> bits == packed[:-1] >> bits) & (found[1:] != found[:-1]))
        if len(alike):
            top = packed >> bits
            mixed = np.flatnonzero(np.isin(top, top[alike]))
            at[mixed] = at[mixed][np.argsort(found[mixed], kind="stable")]
            found = x[at]
    edge = np.concatenate([[True], found[1:] != found[:-1]]) if len(x) else np.zeros(0, bool)
    inverse = np.empty(len(x), np.int64)
    inverse[at] = np.cumsum(edge) - 1
    return found[edge].astype(keys.dtype), inverse, at[edge]


class Block:
    """The texts of a block as numbers of its distinct words, its distinct bigrams, and what it was told of both."""

    def __init__(self, texts: list[bytes], shift: int, told: pa.Table | None = None, rounds: int = 0):
        """Hashes lose `shift` bits; `told` holds the answers of the first `rounds` rounds."""
        self.shift = np.uint64(shift)
        rows = [b for raw in texts for b in pa.ipc.open_stream(raw)]
        self.doc_id = pa.chunked_array([b.column("doc_id") for b in rows], pa.int64())
        hashes, sizes, train = [], [], []
        for part in steps(iter(rows)):
            data, at = text_bytes(part.column("text"))
            starts, ends, first = word_spans(data, at)
            n = np.diff(first) + 1
            end = np.zeros(int(n.sum()), bool)
            end[np.cumsum(n) - 1] = True
            words = np.empty(len(end), np.uint64)
            words[end], words[~end] = _END, word_hashes(data, starts, ends, lower=True)
            hashes.append(words), sizes.append(n), train.append(part.column("train").to_numpy(zero_copy_only=False))
        sizes, train = np.concatenate(sizes), np.concatenate(train)
        self.begin, self.texts_train = np.concatenate([[0], np.cumsum(sizes)]), int(train.sum())
        self.words, tokens, _ = _distinct(np.concatenate([*hashes, [_START]]) >> self.shift)
        self.tokens, self.start, self.train = tokens[:-1], int(tokens[-1]), np.repeat(train, sizes)
        self.n = len(self.words)
        if rounds:
            before = np.roll(self.tokens, 1)
            before[self.begin[:-1]] = self.start
            self.pairs, self.pair_of, _ = _distinct(before * self.n + self.tokens)
        answers = sorted(told.to_pylist(), key=lambda r: r["shard"]) if rounds else []
        self.told = [{c: np.concatenate([np.zeros(0, np.int64), *(_unpacked(r[c]) for r in answers if r["round"] == k)]) for c in ("counts", "kept", "sums")} for k in range(rounds)]
        if rounds > 0:
            self.count = self.told[0]["counts"]
        if rounds > 1:
            self.pair_count, self.kept, _ = self._answer(1)

    def word_counts(self) -> np.ndarray:
        out = np.bincount(self.tokens, weights=self.train, minlength=self.n).astype(np.int64)
        out[self.start] = self.texts_train
        return out

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (bigram, word) that may be kept, and their training counts. All occurrences of a trigram outside this block
        are occurrences of both its bigrams there, which bounds its total from above."""
        if not hasattr(self, "_trigrams"):
            inner = np.ones(len(self.tokens), bool)
            inner[self.begin[:-1]] = False
            at = np.flatnonzero(inner)
            history = self.pair_of[at - 1]
            likely = (self.pair_count[history] >= LEAST_TRIGRAM) & (self.pair_count[self.pair_of[at]] >= LEAST_TRIGRAM)
            at, history = at[likely], history[likely]
            keys, back, first = _distinct(history * self.n + self.tokens[at])
            counts = np.bincount(back, weights=self.train[at], minlength=len(keys)).astype(np.int64)
            elsewhere = self.pair_count - np.bincount(self.pair_of, weights=self.train, minlength=len(self.pairs)).astype(np.int64)
            likely = counts + np.minimum(elsewhere[history[first]], elsewhere[self.pair_of[at[first]]]) >= LEAST_TRIGRAM
            self._trigrams = keys[likely], counts[likely]
        return self._trigrams

    def asked(self, order: int) -> tuple[np.ndarray, ...]:
        """For bigrams (1) or trigrams (2): sorted places, how many n-grams each has, which history it belongs to; and for the
        n-grams in order of place their number, the bits that tell continuations apart, and their training counts."""
        first, second = np.divmod(self.pairs, self.n)
        if order == 1:
            history, word, name, total = first, second, self.words, self.count
            counts = np.bincount(self.pair_of, weights=self.train, minlength=len(self.pairs)).astype(np.int64)
            own = np.flatnonzero((total[history] > 0) & (total[word] > 0))
            asking = np.unique(first)
        else:
            keys, counts = self.trigrams()
            (history, word), name, total = np.divmod(keys, self.n), mix(self.words[second] + self.words[first] * _ODD[0]), self.pair_count
            own, asking = np.arange(len(keys)), np.arange(len(self.pairs))
        history, word, counts = history[own], word[own], counts[own]
        asking = asking[total[asking] >= (1, LEAST_TRIGRAM)[order - 1]]  # whatever continuations the block has
        parts = np.maximum(1, -(-total // PART_TOKENS))
        found = mix(self.words[word] + name[history] * _ODD[1])
        part = (found & np.uint64(0xFFFFFFFF)).astype(np.int64) % parts[history]
        bits = (found >> np.uint64(32)).astype(np.int64)
        every = np.repeat(asking, parts[asking])  # all parts of a history are asked
        inner = np.arange(len(every)) - np.repeat(np.cumsum(parts[asking]) - parts[asking], parts[asking])
        place = lambda h, p: mix(name[h] + (p.astype(np.uint64) + np.uint64(1)) * _ODD[2]) >> self.shift
        places, _, where = _distinct(place(every, inner))
        at = np.searchsorted(places, place(history, part))
        in_order = np.sort((at << 32) | np.arange(len(at))) & 0xFFFFFFFF
        return places, np.bincount(at, minlength=len(places)), every[where], own[in_order], bits[in_order], counts[in_order]

    def _answer(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of all bigrams or trigrams; for all histories their kept arcs, and the sum of these arcs' counts."""
        _, _, history, own, _, _ = self.asked(order)
        total = np.zeros(len(self.pairs) if order == 1 else len(self.trigrams()[0]), np.int64)
        total[own] = self.told[order]["counts"]
        kept, sums = (np.zeros(self.n if order == 1 else len(self.pairs), np.int64) for _ in range(2))
        np.add.at(kept, history, self.told[order]["kept"])
        if order == 2:
            np.add.at(sums, history, self.told[order]["sums"])
        return total, kept, sums

    def automaton(self, space: float, discounts: tuple[float, float]) -> Automaton:
        """The states and arcs that the block's texts can reach."""
        n, c, c2, (d2, d3) = self.n, self.count, self.pair_count, discounts
        first, second = np.divmod(self.pairs, n)
        unigram = (c + 0.5) / space
        weight = np.divide(d2 * self.kept, c, out=np.ones(n), where=c > 0)  # the bigrams kept sum up to c
        seen = np.flatnonzero(c2 >= LEAST_BIGRAM)
        bigram = np.zeros(len(self.pairs))
        bigram[seen] = (c2[seen] - d2) / c[first[seen]] + weight[first[seen]] * unigram[second[seen]]
        c3, kept, sums = self._answer(2)
        keys = self.trigrams()[0]
        deep = np.divide(c2 - sums + d3 * kept, c2, out=np.ones(len(c2)), where=c2 > 0)
        found = np.flatnonzero(c3 >= LEAST_TRIGRAM)
        history, word = np.divmod(keys[found], n)
        shorter = np.searchsorted(self.pairs, second[history] * n + word)
        trigram = (c3[found] - d3) / c2[history] + deep[history] * bigram[shorter]
        home = np.where(c > 0, 1 + np.arange(n), 0)  # the state after a word alone, and after a bigram
        after = np.where(kept > 0, 1 + n + np.arange(len(self.pairs)), home[second])
        return Automaton(
            n, np.concatenate([(1 + first[seen]) * n + second[seen], (1 + n) * n + keys[found]]),
            np.log10(np.concatenate([bigram[seen], trigram])), np.concatenate([after[seen], after[shorter]]),
            np.concatenate([[0], np.zeros(n, np.int64), home[second]]), np.concatenate([[0.0], np.log10(weight, out=np.zeros(n), where=weight > 0), np.log10(deep, out=np.zeros(len(deep)), where=deep > 0)]),
            np.log10(unigram), home, after,
        )


class Automaton:
    """State 0 is the empty history. Arcs are sorted by state times words plus word."""

    def __init__(self, n_words, arcs, weights, targets, failure, failure_weights, empty_weights, empty_targets, after_pair):
        self.n, self.arcs, self.weights, self.targets = n_words, arcs, weights, targets
        self.failure, self.failure_weights, self.empty_weights, self.empty_targets, self.after_pair = failure, failure_weights, empty_weights, empty_targets, after_pair

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word, and what the arcs taken weigh: failure arcs until an arc fits."""
        state, total = state.copy(), np.zeros(len(state))
        going = np.arange(len(state))
        while len(going):
            s, w = state[going], word[going]
            key = s * self.n + w
            at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            fits = (s > 0) & (self.arcs[at] == key) if len(self.arcs) else np.zeros(len(s), bool)
            hit, empty = going[fits], s == 0
            total[hit] += self.weights[at[fits]]
            state[hit] = self.targets[at[fits]]
            last = going[empty]
            total[last] += self.empty_weights[word[last]]
            state[last] = self.empty_targets[word[last]]
            failing = ~fits & ~empty
            going = going[failing]
            total[going] += self.failure_weights[s[failing]]
            state[going] = self.failure[s[failing]]
        return state, total

    def read(self, block: Block) -> np.ndarray:
        """The log-probability of each text."""
        sizes = np.diff(block.begin)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        at = block.begin[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        left = np.minimum(block.begin[text + 1] - at, LANE)
        order = np.argsort(-left, kind="stable")
        text, at, left = text[order], at[order], left[order]
        state = np.where(at == block.begin[text], self.empty_targets[block.start], self.after_pair[block.pair_of[at - 1]])
        score = np.zeros(len(text))
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k))  # lanes with more than k tokens
            state[:n], more = self.step(state[:n], block.tokens[at[:n] + k])
            score[:n] += more
        return np.bincount(text, weights=score, minlength=len(sizes))


# --- rounds


def _range_of(keys: np.ndarray, shards: int, shift: int) -> np.ndarray:
    """The shard of each hash: shards own equal ranges."""
    return ((keys >> np.uint64(32 - shift)).astype(np.int64) * shards) >> 32


_ASKED = "shard long, block long, places binary, sizes binary, bits binary, counts binary"
_TOLD = "round int, shard long, block long, counts binary, kept binary, sums binary, n_low long, n_high long, known long, total long"


def _rows(block: int, shards: int, shift: int, places: np.ndarray, sizes: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A row for each shard that owns one of the places."""
    shard = _range_of(places, shards, shift)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(places)] if len(places) else [0]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = {n: [] for n in ("shard", "block", "places", "sizes", "bits", "counts")}
    for a, b in zip(cuts, cuts[1:]):
        out["shard"].append(int(shard[a]))
        out["block"].append(block)
        out["places"].append(_squeezed(places[a:b]))
        out["sizes"].append(_packed(sizes[a:b]))
        out["bits"].append(_packed(bits[ends[a] : ends[b]]))
        out["counts"].append(_packed(counts[ends[a] : ends[b]]))
    kinds = [("shard", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("places", "sizes", "bits", "counts"))]
    return pa.table(out, schema=pa.schema(kinds))


def _ask_words(shards: int, shift: int):
    def run(key: tuple, texts: pa.Table) -> pa.Table:
        block = Block(texts.column("texts").to_pylist(), shift)
        return _rows(key[0].as_py(), shards, shift, block.words, np.ones(block.n, np.int64), np.zeros(block.n, np.int64), block.word_counts())

    return run


def _ask(order: int, shards: int, shift: int):
    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        places, sizes, _, _, bits, counts = Block(texts.column("texts").to_pylist(), shift, told, order).asked(order)
        return _rows(key[0].as_py(), shards, shift, places, sizes, bits, counts)

    return run


def _tell(order: int, least: int, shift: int = 0) -> Callable[[tuple, pa.Table], pa.Table]:
    """Totals over all blocks for what each block asked: of n-grams, and of what is kept at each place. On the way, how many words
    are known and how often they occur, and how many n-grams occur `least` times and once more."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        rows = list(zip(*(asked.column(n).to_pylist() for n in ("places", "sizes", "bits", "counts"))))
        lists = [(_spread(p), _unpacked(s), _unpacked(b), _unpacked(c)) for p, s, b, c in rows]
        places, where, _ = _distinct(np.concatenate([x[0] for x in lists]))
        sizes = np.concatenate([x[1] for x in lists])
        at = np.repeat(where, sizes)
        grams, back, _ = _distinct((at << 32) | np.concatenate([x[2] for x in lists]))
        sums = np.bincount(back, weights=np.concatenate([x[3] for x in lists]), minlength=len(grams)).astype(np.int64)
        kept = sums >= least
        place = grams[kept] >> 32
        n_kept, sum_kept = np.bincount(place, minlength=len(places)), np.bincount(place, weights=sums[kept], minlength=len(places)).astype(np.int64)
        counted = sums[(places != _START >> np.uint64(shift))[grams >> 32] & (sums > 0)]
        facts = {"n_low": int((sums == least).sum()), "n_high": int((sums == least + 1).sum()), "known": len(counted), "total": int(counted.sum())}
        ends, tops = np.cumsum([x[1].sum() for x in lists]), np.cumsum([len(x[0]) for x in lists])
        cut_up = lambda x, e: [_packed(part) for part in np.split(x, e[:-1])]
        none = [_packed(np.zeros(0, np.int64))] * len(lists)
        n = len(lists)
        return pa.table(
            {
                "round": pa.array([order] * n, pa.int32()), "shard": pa.array([key[0].as_py()] * n, pa.int64()), "block": asked.column("block"),
                "counts": pa.array(cut_up(sums[back], ends), pa.binary()),
                "kept": pa.array(cut_up(n_kept[where], tops) if order else none, pa.binary()),
                "sums": pa.array(cut_up(sum_kept[where], tops) if order == 2 else none, pa.binary()),
                **{k: pa.array([v] + [0] * (n - 1), pa.int64()) for k, v in facts.items()},
            }
        )

    return run


def _traverse(shift: int):
    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        facts = [told.column(f"facts_{k}")[0].as_py() for k in range(ORDERS)]
        known, total = facts[0]["known"], facts[0]["total"]
        discounts = tuple(discount(least, facts[k]["n_low"], facts[k]["n_high"]) for k, least in ((1, LEAST_BIGRAM), (2, LEAST_TRIGRAM)))
        block = Block(texts.column("texts").to_pylist(), shift, told, ORDERS)
        automaton = block.automaton(total + 0.5 * (known + 1), discounts)
        add = lambda x: np.add.reduceat(x, block.begin[:-1])
        return pa.table(
            {
                "doc_id": block.doc_id, "n_tokens": pa.array(np.diff(block.begin)), "n_known": pa.array(add((block.count[block.tokens] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(block.begin) - 1, total, np.int64)), "base_score": pa.array(add(automaton.empty_weights[block.tokens])), "score": pa.array(automaton.read(block)),
            }
        )

    return run


def discount(least: int, n_low: int, n_high: int) -> float:
    """What the smallest kept count loses in its Good-Turing estimate, within bounds that keep all weights positive."""
    lost = least - (least + 1) * n_high / n_low if n_low else least / 2
    return min(max(lost, 0.1 * least), 0.9 * least)


def score(docs: DataFrame, train=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score (the automaton's log10 probability).

    `train` is a boolean column that marks the rows to learn from; by default the fold rule on doc_id."""
    train = ~held_out(F.col("doc_id"), FOLDS, HELD_OUT) if train is None else train
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, shift = max(1, -(-size // block_bytes)), 64 - min(64, max(40, 26 + size.bit_length()))
    shards = [max(1, -(-size // each)) for each in SHARD_BYTES]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).mapInArrow(_pack_texts, "block long, texts binary").groupBy("block")

    sums = F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_low", "n_high", "known", "total"))).alias("facts")
    told, facts = None, {}
    for order, least in enumerate((1, LEAST_BIGRAM, LEAST_TRIGRAM)):
        if told is None:
            asked = dealt.applyInArrow(_ask_words(shards[0], shift), _ASKED)
        else:
            asked = dealt.cogroup(told.groupBy("block")).applyInArrow(_ask(order, shards[order], shift), _ASKED)
        more = asked.groupBy("shard").applyInArrow(_tell(order, least, shift), _TOLD)
        facts[f"facts_{order}"] = more.agg(sums).scalar()
        told = more if told is None else told.unionByName(more)
    told = told.select("round", "shard", "block", "counts", "kept", "sums", *(c.alias(n) for n, c in facts.items()))
    return dealt.cogroup(told.groupBy("block")).applyInArrow(
        _traverse(shift), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
