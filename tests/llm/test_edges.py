"""Each operator has a defined result on odd rows, on an empty table, and without labels."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickspark.llm import backoff_lm, bpe, fingerprints, jaccard_join, ngram_rules, packing, quality_net, substring_dedup, token_counts, toxicity

PER_ROW = {
    "quality": lambda d, labels: quality_net.score(d, quality_net.fit(d, labels)),
    "fingerprints": lambda d, labels: fingerprints.compared(d),
    "rules": lambda d, labels: ngram_rules.judge(d, labels),
    "substring": lambda d, labels: substring_dedup.substring_dedup(d),
    "bpe": lambda d, labels: bpe.decode(bpe.encode(d)),
    "toxicity": lambda d, labels: toxicity.score(d, toxicity.fit(d, labels)),
    "jaccard": lambda d, labels: jaccard_join.near_duplicates(d),
    "lm": lambda d, labels: backoff_lm.score(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each(name, odd, empty, odd_labels, no_labels):
    count = odd.count()
    ids = sorted((r[0] is None, r[0] or 0) for r in odd.select("doc_id").collect())
    for labels in (odd_labels, no_labels):
        found = PER_ROW[name](odd, labels).collect()
        assert len(found) == count
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == ids
    assert PER_ROW[name](empty, no_labels).collect() == []


def test_scores_are_probabilities(odd, odd_labels):
    for name in ("quality", "toxicity"):
        assert all(0.0 <= r["score"] <= 1.0 for r in PER_ROW[name](odd, odd_labels).collect())


def test_packing_and_counts(odd, empty):
    for d in (odd, empty):
        packed = packing.pack(packing.pieces(d)).collect()
        rows = d.count()
        assert sum(r["piece"] == 0 for r in packed) == rows
        counted = token_counts.count_tokens(d)
        assert counted.where("section = 0").count() == rows
    total = token_counts.count_tokens(odd).agg(F.sum("n_tokens")).first()[0]
    assert total == sum(r["length"] for r in packing.pack(packing.pieces(odd)).collect()) - odd.count()


def test_several_fields(odd):
    counted = token_counts.count_tokens(odd, ["lang", "text"]).collect()
    assert {r["field"] for r in counted} == {"lang", "text"}


def test_equal_texts_equal_fingerprints(odd):
    by = {}
    for r in fingerprints.fingerprints(odd).select("text", "bits").collect():
        assert by.setdefault(r["text"], r["bits"]) == r["bits"]


def test_copies_share_a_class(odd):
    found = {r["doc_id"]: r for r in jaccard_join.near_duplicates(odd).where("doc_id is not null").collect()}
    assert found[7]["class_id"] == found[9]["class_id"] == 7
    assert found[9]["n_copies"] == 3
    assert found[1]["class_id"] == found[2]["class_id"] == 1  # null counts as empty
    assert found[4]["class_id"] == 4 and found[4]["n_links"] == 0


def test_repeats_are_cut_once(odd):
    found = {}
    for r in substring_dedup.substring_dedup(odd).collect():
        found.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert found[7] == [0] and found[8] == [60] and found[9] == [62, 62] and found[None] == [0, 0]


def test_stages_keep_columns(spark, odd, empty, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
            own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
            assert out.select(own).distinct().exceptAll(docs.select(own).distinct()).count() == 0  # no column is changed on the way


def test_packing_keeps_columns(odd):
    """Columns with the names that packing uses travel with their pieces; its own results replace theirs."""
    names = ["rank", "_salt", "_before", "_inner", "before", "inner", "salt", "n", "held", "offset"]
    found = packing.pieces(odd).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    packed = packing.pack(found)
    assert packed.columns == [*found.drop("offset").columns, "sequence_id", "offset"]
    plain = packing.pack(packing.pieces(odd))
    assert sorted(map(tuple, packed.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert {tuple(r) for r in packed.select(*names[:-1]).collect()} == {tuple(range(9))}


def test_stage_results(spark, odd, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = [r[0] for r in corpus_pipeline.drop_near_copies(spark, odd, str(tmp_path)).select("doc_id").collect()]
    assert 7 in kept and 9 not in kept and 8 not in kept and len([k for k in kept if k is not None]) == len({k for k in kept if k is not None})
    texts = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, odd, str(tmp_path)).collect()}
    assert texts[8]["text"] == "head" and texts[8]["n_chars"] == 4
    assert texts[14]["text"] == "Same Line\nSame Line\nOther\n" and texts[14]["n_chars"] == 5
