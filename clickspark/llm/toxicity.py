"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and the context of each hit.

The lexicon is learned from labelled rows: whole words, and stems that many words begin with, which documents labelled toxic
hold far more often than others would by chance. A stem must do so without the one word that speaks most for it. The trie,
intersected with the Levenshtein automaton of distance one, is made deterministic once; all words of a batch then walk it
together, one character a step, and nearly all die within a few steps. A word hits a term exactly, or at distance one (two
neighbours that change places included) if the term has four characters or more; stems are met exactly, and stand beside the
whole terms that begin with them. An exact hit weighs as its term did in the labels. A near hit whose spelling stands in two
labelled rows or more weighs as that spelling did; any other weighs as spellings met once did, or `NEAR_SHARE` of the exact
weight where the labels have none. The window of `WINDOW` words around a hit says whether it is quoted and whether other hits
stand near; a logistic regression over these sums gives the score.

Bounds: at most `LABELLED_ROWS` labelled rows are learned from, and every term and spelling that they bear out is kept; scoring
covers all rows and texts.

Edge cases: null text counts as empty, and texts without a hit get the score that such texts have; without labelled rows, or
with one label alone, the score is the same for all; a null label or doc_id is not learned from; of rows that share an id the
smallest text is learned from; rows that repeat are scored each; other input columns are ignored by `score` and kept by
`keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, one_text_each, steps
from .linear import fit_logistic, sigmoid

FOLDS, HELD_OUT = 5, 0
LABELLED_ROWS = 20_000
FUZZY_LENGTH, STEM_LENGTHS, WINDOW = 4, (4, 5, 6), 6

#: The weight of a near hit before any is labelled, as a share of the exact hit's, and the labelled ones that outweigh it.
NEAR_SHARE, NEAR_PRIOR = 0.75, 2.0

#: Characters that open or close a quotation.
QUOTES = "\"“”„«»‹›"

#: Characters up to here can be letters or digits; those beyond count as neither.
_PLANE = 1 << 18
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(map(chr, range(_PLANE)))], np.uint32)
_ALNUM = np.array([chr(i).isalnum() for i in range(_PLANE)])
_BLANK = np.zeros(_PLANE, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_QUOTE = np.zeros(_PLANE, bool)
_QUOTE[[ord(c) for c in QUOTES]] = True

#: The same words in Spark: from the first letter or digit of a run without blanks to the last.
_TERM = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case characters of all texts, starts and ends of words in them, each text's first word (one more), and how many
    quotation marks stand before each character."""
    chars = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le"), np.uint32)
    low = np.minimum(chars, _PLANE - 1)
    blank, solid = _BLANK[low], np.flatnonzero(_ALNUM[low])
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    if len(solid):
        first = solid[np.minimum(np.searchsorted(solid, starts), len(solid) - 1)]
        last = solid[np.searchsorted(solid, ends) - 1] + 1
        bare = (first < starts) | (first >= ends)
        first, last = np.where(bare, starts, first), np.where(bare, starts, last)
    else:
        first = last = starts
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    quotes = np.concatenate([[0], np.cumsum(_QUOTE[low])])
    return np.where(chars < _PLANE, _LOWER[low], chars), first, last, np.searchsorted(starts, begin), quotes


#: The error of a state in which two neighbours of the term are half through changing places; its node is negative.
_SWAPPED = 2


@dataclass
class Node:
    below: dict[int, int] = field(default_factory=dict)
    term: int = -1
    stem: int = -1
    above: int = -1  # the letter before this node's own


class Automaton:
    """Deterministic intersection of a lexicon's trie with the Levenshtein automaton of distance one. A state is a set of trie
    nodes with their errors, and the stem that the word began with."""

    def __init__(self, terms: list[tuple[str, bool]], swaps: bool = False):
        """terms: (text, is a stem); with `swaps` two neighbours that change places are one error."""
        self.symbols = np.zeros(_PLANE, np.int32)
        letters = sorted({ord(c) for t, _ in terms for c in t if ord(c) < _PLANE})
        self.symbols[letters] = np.arange(1, len(letters) + 1)
        nodes = [Node()]
        for k, (text, stem) in enumerate(terms):
            at, before = 0, -1
            for c in text:
                s = int(self.symbols[min(ord(c), _PLANE - 1)])
                if s not in nodes[at].below:
                    nodes[at].below[s] = len(nodes)
                    nodes.append(Node(above=before))
                at, before = nodes[at].below[s], s
            if stem:
                nodes[at].stem = k
            else:
                nodes[at].term = k
        fuzzy = [len(t) >= FUZZY_LENGTH for t, _ in terms]
        start = (frozenset([(0, 0)]), -1)
        states: dict = {(frozenset(), -1): 0, start: 1}
        queue, arcs, hits = list(states), [], []
        for state in queue:  # grows while it is walked
            pairs, stem = state
            arcs.append({})
            hits.append((*self._hit(nodes, pairs, fuzzy), stem))
            likely = {s for n, _ in pairs for s in (nodes[n].below if n >= 0 else [nodes[-n].above])}
            likely |= {s for n, e in pairs if not e for c in nodes[n].below.values() for s in nodes[c].below}
            for symbol in [None, *sorted(likely)]:
                told = self._step(nodes, pairs, symbol, swaps)
                to = (told, stem if stem >= 0 else next((s for n, e in sorted(told) if not e and (s := nodes[n].stem) >= 0), -1))
                if to not in states:
                    states[to] = len(states)
                    queue.append(to)
                arcs[-1][symbol] = states[to]
        self.arcs = np.zeros((len(states), len(letters) + 1), np.int32)
        for i, told in enumerate(arcs):
            self.arcs[i] = told.get(None, 0)
            for symbol, to in told.items():
                if symbol is not None:
                    self.arcs[i, symbol] = to
        self.stem = np.array([h[2] for h in hits], np.int32)
        self.term = np.array([h[2] if h[0] < 0 else h[0] for h in hits], np.int32)
        self.distance = np.array([h[1] for h in hits], np.int32)

    @staticmethod
    def _step(nodes: list[Node], state: frozenset, symbol: int | None, swaps: bool) -> frozenset:
        out = set()
        for n, e in state:
            if e == _SWAPPED:  # only the letter that the one before has overtaken
                if symbol == nodes[-n].above:
                    out.add((-n, 1))
                continue
            below = nodes[n].below
            if symbol in below:
                out.add((below[symbol], e))
            if not e:
                out.add((n, 1))  # one more character in the text
                for c in below.values():
                    out.add((c, 1))  # another character in the text
                    if symbol in nodes[c].below:
                        out.add((nodes[c].below[symbol], 1))  # one character of the term left out
                        if swaps:
                            out.add((-nodes[c].below[symbol], _SWAPPED))
        return frozenset((n, e) for n, e in out if not e or (n, 0) not in out)

    @staticmethod
    def _hit(nodes: list[Node], state: frozenset, fuzzy: list[bool]) -> tuple[int, int]:
        found = [(e, nodes[n].term) for n, e in state if n >= 0 and nodes[n].term >= 0 and (not e or fuzzy[nodes[n].term])]
        found += [(1, t) for n, e in state if not e for c in nodes[n].below.values() if (t := nodes[c].term) >= 0 and fuzzy[t]]
        if not found:
            return -1, 0
        distance, term = min(found)
        return term, distance

    def find(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words that hit, their terms and distances. A word that begins with a stem has the stem for its term, at distance
        zero, unless it is or is near a whole term."""
        hit, state = self.walk(chars, starts, ends)
        return hit, self.term[state], self.distance[state]

    def walk(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that hit, and the states they end in."""
        codes = self.symbols[np.minimum(chars, _PLANE - 1)]
        state, walking, at = np.ones(len(starts), np.int32), np.flatnonzero(ends > starts), 0
        state[ends <= starts] = 0
        while len(walking):
            state[walking] = self.arcs[state[walking], codes[starts[walking] + at]]
            at += 1
            walking = walking[(state[walking] > 0) & (starts[walking] + at < ends[walking])]
        hit = np.flatnonzero(self.term[state] >= 0)
        return hit, state[hit]


def _spellings(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [chars[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(starts.tolist(), ends.tolist())]


@dataclass
class Model:
    automaton: Automaton
    exact: np.ndarray
    near: np.ndarray
    weights: np.ndarray = None
    bias: float = 0.0
    spelt: dict[str, float] = field(default_factory=dict)  # weights of spellings at distance one

    def near_hits(self, texts: list[str]) -> list[set[tuple[int, str]]]:
        """The terms and spellings of each text's near hits."""
        chars, starts, ends, first, _ = words(texts)
        hit, term, distance = self.automaton.find(chars, starts, ends)
        near = distance > 0
        row, out = np.searchsorted(first, hit, side="right") - 1, [set() for _ in texts]
        for r, t, w in zip(row[near].tolist(), term[near].tolist(), _spellings(chars, starts[hit[near]], ends[hit[near]])):
            out[r].add((t, w))
        return out

    def _weigh(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
        term, stem, near = self.automaton.term[state], self.automaton.stem[state], np.flatnonzero(self.automaton.distance[state] > 0)
        if not len(state):
            return np.zeros(0)
        weight = self.exact[term]
        found = _spellings(chars, starts[near], ends[near])
        weight[near] = [self.spelt.get(w, u) for w, u in zip(found, self.near[term[near]].tolist())]
        begun = near[stem[near] >= 0]
        weight[begun] = np.maximum(weight[begun], self.exact[stem[begun]])
        return weight

    def features(self, texts: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """A row of features for each text, and the pairs (text, term) of near hits."""
        chars, starts, ends, first, quotes = words(texts)
        hit, state = self.automaton.walk(chars, starts, ends)
        term, distance = self.automaton.term[state], self.automaton.distance[state]
        row = np.searchsorted(first, hit, side="right") - 1
        weight = self._weigh(chars, starts[hit], ends[hit], state)
        low, high = np.maximum(hit - WINDOW, first[row]), np.minimum(hit + WINDOW, first[row + 1] - 1)
        before = quotes[starts[hit]] - quotes[starts[low]] + (_QUOTE[np.minimum(chars[np.maximum(starts[low] - 1, 0)], _PLANE - 1)] & (starts[low] > 0))
        after = quotes[np.minimum(ends[high] + 1, len(chars))] - quotes[ends[hit]]
        quoted = (before % 2 == 1) & (after >= 1)
        beside = np.searchsorted(hit, high, side="right") - np.searchsorted(hit, low) - 1
        n = len(texts)
        sums = lambda w: np.bincount(row, weights=w, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, row, np.where(quoted, 0.5, 1.0) * weight)
        length = np.maximum(np.diff(first), 1)
        found = np.column_stack([most, np.log1p(sums(weight * ~quoted)), np.log1p(sums(weight * quoted)), np.log1p(sums(weight * (beside > 0))), np.log1p(1000.0 * sums(weight) / length)])
        near = distance > 0
        return found, (row[near], term[near])

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.features(texts)[0] @ self.weights + self.bias)


def _lexicon(rows: DataFrame) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """Terms that toxic rows hold beyond chance, the most surprising first, and their log odds. What is collected is bounded by
    the sample of labelled rows. A stem's counts leave out its word in most toxic rows, so that no single word makes a stem."""
    positives, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not 0 < positives < total:
        return [], np.zeros(0)
    own = rows.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))).alias("term"))
    counted = own.groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n"), F.lit(1).alias("kinds"))
    stems = [
        counted.where(F.length("term") > k).groupBy(F.substring("term", 1, k).alias("term")).agg((F.sum("a") - F.max("a")).alias("a"), (F.sum("n") - F.max(F.struct("a", "n"))["n"]).alias("n"), F.count("*").alias("kinds")).where("kinds >= 5 and n > 0")
        for k in STEM_LENGTHS
    ]
    both = counted.withColumn("stem", F.lit(False))
    for s in stems:
        both = both.unionByName(s.withColumn("stem", F.lit(True)))
    prior = positives / total
    share = F.least(F.col("a") / F.col("n"), F.lit(1 - 1e-9))
    surprise = F.col("n") * (share * F.log(share / prior) + (1 - share) * F.log((1 - share) / (1 - prior)))
    odds = F.log((F.col("a") + 0.1) / (positives + 0.2)) - F.log((F.col("n") - F.col("a") + 0.1) / (total - positives + 0.2))
    told = both.where(share > prior).withColumns({"odds": odds, "surprise": surprise}).where(F.col("odds") > np.log(20.0))
    needed = np.log(max(10_000, 50 * total)) + 2.0
    best = told.where(F.col("surprise") >= needed).orderBy(F.desc("surprise"), "term", "stem").collect()
    stems_kept: list[str] = []
    for r in sorted((r for r in best if r["stem"]), key=lambda r: len(r["term"])):  # a stem that begins with another adds nothing
        if not r["term"].startswith(tuple(stems_kept)):
            stems_kept.append(r["term"])
    kept = [(r["term"], r["stem"], r["odds"]) for r in best if not r["stem"] or r["term"] in stems_kept]
    return [(t, s) for t, s, _ in kept], np.array([o for _, _, o in kept])


def _learned(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """text and label of a bounded sample of labelled rows; ids and labels are small enough to be broadcast."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("long").alias("label"))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    return one_text_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("text", "label")


def _found(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = model.features(batch.column("text").to_pylist())[0]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["label", "found"])

    return run


def _near(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            told = [(y, t, w) for y, hits in zip(batch.column("label").to_pylist(), model.near_hits(batch.column("text").to_pylist())) for t, w in sorted(hits)]
            label, term, word = zip(*told) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(term, pa.int32()), pa.array(word, pa.string())], ["label", "term", "word"])

    return run


def _learn_near(rows: DataFrame, model: Model) -> None:
    """Weights of near hits. A spelling in one labelled row stands for those that the labels lack, and weighs as they do."""
    positives, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    odds = lambda a, n: np.log((a + 0.5) / (positives + 1.0)) - np.log((n - a + 0.5) / (total - positives + 1.0))
    blend = lambda a, n, prior: (n * odds(a, n) + NEAR_PRIOR * prior) / (n + NEAR_PRIOR)
    counted = rows.mapInArrow(_near(model), "label long, term int, word string").groupBy("word", "term").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    a, n = np.zeros(len(model.exact)), np.zeros(len(model.exact))
    for term, hits, count in counted.where("n = 1").groupBy("term").agg(F.sum("a"), F.count("*")).collect():  # a row for each term
        a[term], n[term] = hits, count
    model.near = np.clip(blend(a, n, NEAR_SHARE * model.exact), 0.0, model.exact)
    for r in counted.where("n > 1").orderBy(F.desc("n"), "word").collect():
        model.spelt[r["word"]] = float(np.clip(odds(r["a"], r["n"]), 0.0, model.exact[r["term"]]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learns the lexicon, the weights of near hits, and the regression from labelled rows (labels: doc_id and the label)."""
    rows = _learned(docs, labels, label).persist()
    try:
        terms, odds = _lexicon(rows)
        model = Model(Automaton(terms, swaps=True), odds, np.zeros(len(terms)))
        _learn_near(rows, model)
        found = rows.mapInArrow(_found(model), "label long, found array<double>").collect()
    finally:
        rows.unpersist()
    x = np.array([r["found"] for r in found], float).reshape(len(found), 5)
    model.weights, model.bias = fit_logistic(x, np.array([r["label"] for r in found], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, 0 to 1, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            scores = model.score(pc.fill_null(batch.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield batch.filter(pa.array(model.score(pc.fill_null(batch.column("text"), "").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def training_fold(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
