"""Cases that a review found to be cut short."""

import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickspark.llm import bpe, jaccard_join, packing, quality_net, substring_dedup, token_counts, toxicity


# --- tokens


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 400_000, "\u3000\xa0" * 500_000])
def test_long_runs_of_white_space(run):
    reference = Tokenizer.from_file(bpe.default_path())
    for text in (run + "a", "it's " + run, "x" + run + "12<|endoftext|>" + run + "! " + run[: packing.LONG_RUN] + "\ny"):
        assert packing._ids(bpe.default_path(), text) == reference.encode(text, add_special_tokens=False).ids


def test_white_space_through_the_operators(spark):
    text = "a" + " " * 2_000_000 + "b\nc"
    ids = [*Tokenizer.from_file(bpe.default_path()).encode(text, add_special_tokens=False).ids, packing.END]
    docs = spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs)).where("doc_id = 1").collect()
    assert len(rows) == -(-len(ids) // packing.CAPACITY)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in rows)
    assert sum(r["n_tokens"] for r in token_counts.count_tokens(docs).where("doc_id = 1").collect()) == len(ids) - 1


def _encoder():
    return bpe.Encoder(bpe.vocabulary(bpe.default_path()), bpe.Transducer.build({b" the": bpe.vocabulary(bpe.default_path()).merge([b" the"])[0]}))


def test_long_words():
    """A megabyte of letters and texts without blanks take seconds, leave nothing behind, and equal the library's ids."""
    rng, reference, encoder = np.random.default_rng(2), Tokenizer.from_file(bpe.default_path()), _encoder()
    letters = "".join(rng.choice(list("etaoinshrdlu"), 1_000_000))
    wide = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 1_700_000)))
    texts = [letters, wide, "a" * 300_001, "ab" * 1000 + " " + "the" * 700, letters[:600] + " " + letters[600:1200]]
    began = time.time()
    found = encoder.encode(texts)
    assert time.time() - began < 20
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
    assert all(len(p) <= bpe.REMEMBERED_LENGTH for ages in (encoder.first, encoder.later) for age in ages for p in age)


def test_long_words_do_not_reach_the_driver(spark):
    """Texts without blanks, copied many times, give no words to the lexicon, and are encoded all the same."""
    rng, reference = np.random.default_rng(4), Tokenizer.from_file(bpe.default_path())
    wide = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 400_000)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([wide] * 6 + ["plain words " + "q" * 65, "plain " + "q" * 64])], "doc_id long, text string").repartition(3)
    words = bpe.frequent_words(docs)
    assert sorted(words) == sorted(["plain", "words", "q" * 64])
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(docs).collect()}
    ids = reference.encode(wide, add_special_tokens=False).ids
    assert all(found[i] == ids for i in range(6)) and found[7] == reference.encode("plain " + "q" * 64, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet="aeth ", min_size=1, max_size=60), min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_both_ways_to_merge_agree(words):
    own = bpe.vocabulary(bpe.default_path())
    assert own.in_order
    raw = [w.encode() for w in words]
    assert own._merge_long(raw) == own.merge(raw)


# --- toxicity


def _near(term, word):
    """Whether one letter more, less or changed, or two neighbours that change places, make the word of the term."""
    i = next((k for k, (a, b) in enumerate(zip(term, word)) if a != b), min(len(term), len(word)))
    a, b = term[i:], word[i:]
    return a != b and (a[1:] == b or a == b[1:] or a[1:] == b[1:] and a and b or a[:2] == b[:2][::-1] and a[2:] == b[2:])


_WORDS = st.text(alphabet="abcé", min_size=2, max_size=7)


@given(st.lists(_WORDS, min_size=1, max_size=6, unique=True), st.sets(st.text(alphabet="abcé", min_size=2, max_size=3), max_size=2), st.lists(st.text(alphabet="abcdé", min_size=1, max_size=8), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_swaps_and_stems(terms, stems, words):
    both = [(t, False) for t in terms] + [(t, True) for t in sorted(stems)]
    made = toxicity.Automaton(both, swaps=True)
    chars, starts, ends, _, _ = toxicity.words([" ".join(words)])
    hit, state = made.walk(chars, starts, ends)
    found = {int(h): (int(made.distance[s]), int(made.term[s]), int(made.stem[s])) for h, s in zip(hit, state)}
    for k, w in enumerate(words):
        near = [(0, i) for i, t in enumerate(terms) if t == w] or [(1, i) for i, t in enumerate(terms) if len(t) >= toxicity.FUZZY_LENGTH and _near(t, w)]
        begun = [i for i, (t, stem) in enumerate(both) if stem and w.startswith(t)]
        stem = min(begun, key=lambda i: len(both[i][0])) if begun else -1
        assert found.get(k) == ((*min(near), stem) if near else (0, stem, stem) if begun else None)


def test_misspelled_toxic_texts(spark):
    """Terms are learned from texts that spell them right; 'lose' begins many clean words and 'scam' is clean."""
    terms, clean = ["loser", "scum", "idiot"], ["losesr", "losean", "loseta", "losene", "losery", "scam", "table", "river"]
    other = lambda i: " ".join(f"n{(i * 7 + k) % 90}" for k in range(40))
    rows = [(i, f"{other(i)} {terms[i % 3] if i % 4 == 0 else clean[i % 8]} {other(i + 5)}", int(i % 4 == 0)) for i in range(400)]
    rows += [(400 + i, f"{other(i)} {clean[i % 8]}", 0) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.drop("text"))
    wrong = ["l0ser", "loer", "lsoer", "losser", "scumm", "5cum", "scmu", "idiott", "id1ot", "idoit"]
    assert all(model.score([f"{other(i)} {w}" for i, w in enumerate([*terms, *wrong])]) >= 0.5)
    assert all(model.score([f"{other(i)} {w}" for i, w in enumerate([*clean, "chair", ""])]) < 0.5)


def test_no_term_is_left_out(spark):
    """Three hundred toxic words are all learned, and none stands in for another."""
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(420)})
    toxic, clean = words[:300], words[300:]
    pick = lambda of, i, k: " ".join(of[(7 * i + 11 * j) % len(of)] for j in range(k))
    rows = [(i, f"{pick(clean, i, 30)} {pick(toxic, i, 20)}" if i % 4 == 0 else pick(clean, i, 40), int(i % 4 == 0)) for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(table.drop("toxic"), table.drop("text"))
    found, _ = toxicity._lexicon(table.withColumnRenamed("toxic", "label").select("text", "label"))
    assert {t for t, stem in found if not stem} >= set(toxic)
    assert all(model.score([f"{pick(clean, i, 20)} {w}" for i, w in enumerate(toxic)]) >= 0.5)
    assert all(model.score([pick(clean, i, 20) for i in range(50)]) < 0.5)


def test_letters_beyond_the_first_plane(spark):
    """The scorer cuts words as the learner does, whatever plane their letters are on."""
    texts = ["𝓬cafe𝓭 x", "𠀀𠀁 b", "🙂abc🙂 𝟙𝟚", "-𐐀𐐨- 󠀁a"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    learned = [r[0] for r in table.select(F.regexp_extract_all(F.lower("text"), F.lit(toxicity._TERM), F.lit(0))).collect()]
    for text, expected in zip(texts, learned):
        chars, starts, ends, _, _ = toxicity.words([text])
        found = toxicity._spellings(chars, starts, ends)
        assert found == [w.lower() for w in expected]


def test_an_id_with_many_rows_teaches_once(spark):
    """A third of all rows share one id; what is learned from stays one row for each id."""
    rows = [(i, f"plain {i}") for i in range(1, 41)] + [(0, f"again {i}") for i in range(10, 30)] + [(0, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(41)] + [(0, 1), (None, 1)], "doc_id long, toxic int")
    told = [tuple(r) for r in toxicity._learned(docs, marks, "toxic").collect()]
    assert sorted(told) == sorted([("", 1)] + [(f"plain {i}", i % 2) for i in range(1, 41)])
    marks = marks.withColumnRenamed("toxic", "quality")
    few = docs.where("doc_id between 1 and 40").unionByName(spark.createDataFrame([(0, "")], "doc_id long, text string"))
    nets = [quality_net.fit(d, marks) for d in (docs, few)]
    assert np.array_equal(nets[0].weights, nets[1].weights)


# --- Jaccard join


def _many(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_one_of_each_by_text(spark):
    """Different texts without an id or of one id all stay; near and equal copies of a kept text go, with or without an id."""
    near = _many("a") + " more"
    rows = [(1, _many("a")), (2, near), (None, _many("a")), (None, _many("b")), (None, _many("b")), (None, _many("c")), (None, None), (3, _many("d")), (3, _many("e")), (3, _many("e")), (4, _many("e") + " x"), (5, _many("f")), (5, _many("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, jaccard_join.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(1, _many("a")), (None, _many("b")), (None, _many("c")), (None, None), (3, _many("d")), (3, _many("e")), (5, _many("f"))], key=repr)
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_texts_of_one_id_are_compared_each(spark):
    rows = [(3, _many("d")), (3, _many("e")), (4, _many("e") + " x"), (5, _many("d") + " x"), (6, _many("d")), (6, _many("g")), (7, _many("g") + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"], r["n_text_links"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert found == [(3, 3, 1, 1, 1), (3, 3, 2, 2, 1), (4, 3, 1, 1, 1), (5, 3, 1, 2, 1), (6, 3, 2, 2, 1), (6, 6, 1, 1, 1), (7, 6, 1, 1, 1)]


# --- substring deduplication


def test_only_the_copied_text_of_an_id_goes(spark):
    own = _many("u", 70)
    rows = [(1, _many("a", 70)), (2, _many("a", 70)), (2, own), (3, "head " + own), (4, _many("a", 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert found == [(1, 0, _many("a", 70)), (2, 0, own), (2, 70, ""), (3, 70, "head"), (4, 70, "")]
    assert sorted(r["text"] for r in substring_dedup.without_repeats(docs).collect()) == sorted(["", "", _many("a", 70), own, "head"])


def test_buckets_of_other_members_are_not_taken_for_one(spark):
    """Ids of which sums of forty-bit hashes once met."""
    ids = (5472370, 5472371, 5938754, 5938755)
    docs = spark.createDataFrame([(i, _many("ab"[k // 2], 80) + " tail" * (k % 2)) for k, i in enumerate(ids)], "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == {ids[0]: (ids[0], 1), ids[1]: (ids[0], 1), ids[2]: (ids[2], 1), ids[3]: (ids[2], 1)}


def test_blocks_are_bounded_in_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    rows = [(i, _many("s", 100) + (f" t{i}" if i % 3 else f" u{i} " + _many("v", 9))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r["class_id"], r["n_links"], r["n_text_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == {(0, 23, 23)}


def test_rows_without_an_id_and_repeated_ids_keep_one_row_for_each_class(spark):
    """Each different text keeps one row, whatever its ids; of near copies the smallest id stays."""
    texts = [_many(c) for c in "pqrstu"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (9, texts[2]), (9, texts[3]), (9, texts[3]), (4, texts[4]), (8, texts[4] + " x"), (None, texts[4]), (None, texts[5]), (2, texts[5])]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["text"], r["doc_id"]) for r in kept if r["doc_id"] is not None) == sorted([(texts[2], 9), (texts[3], 9), (texts[4], 4), (texts[5], 2)])
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == sorted(texts[:2])


def test_components_take_few_jobs_and_tasks(spark, monkeypatch):
    """Edges that are stars already need no step, and a step computes each half once: on tables of many partitions their tasks were
    most of the time."""
    from clickspark.llm import components

    steps, told = [], components.with_totals
    monkeypatch.setattr(components, "with_totals", lambda *a, **k: steps.append(1) or told(*a, **k))
    stars = spark.createDataFrame([(10 * k + i, 10 * k) for k in range(1, 4) for i in range(1, 6)], "a long, b long")
    found = dict(map(tuple, components.components(stars).collect()))
    assert found == {10 * k + i: 10 * k for k in range(1, 4) for i in range(6)} and not steps

    chain = [(i, i + 1) for i in range(1, 20)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    found = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long").repartition(9)).collect()))
    assert found == {**{i: 1 for i in range(1, 21)}, 100: 100, 200: 100, 150: 100} and steps
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
