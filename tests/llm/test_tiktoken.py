"""Operator 11 against the library on whole texts."""

import base64
import hashlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from clickspark.llm import queries, tiktoken_bpe


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return tiktoken_bpe.Coder(tiktoken_bpe.default_path(), tiktoken_bpe.default_pattern())


@given(st.text(alphabet="ab'stréЯ日。1２ \n\t \x1c\x85!-<🙂", max_size=80), st.integers(1, 9), st.integers(2, 6))
@settings(max_examples=400, deadline=None)
def test_cuts_change_nothing(library, coder, text, part, run):
    """With parts and runs of a few characters, ids are those of the whole text."""
    from unittest import mock

    runs = tiktoken_bpe.regex.compile(rf"(?<![{tiktoken_bpe._BLANK}])[{tiktoken_bpe._BLANK}]{{{run},}}+")
    with mock.patch.multiple(tiktoken_bpe, PART=part, _RUN=runs, DECODED=3):
        with mock.patch.object(tiktoken_bpe, "parts", lambda t, f=tiktoken_bpe.parts: f(t, part)):
            ids = coder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
        assert "".join(tiktoken_bpe.parts(text, part)) == text


@pytest.mark.parametrize("text", ["ab" * 700_000, "日本語。" * 120_000, "!" * 300_000, "word 12, " * 50_000, "é" * 200_000 + " x", "a\n" * 200_000, "it's " * 40_000 + "<|endoftext|>"])
def test_long_texts(library, coder, text):
    assert coder.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n \t" * 500_000, "　\xa0" * 600_000])
def test_runs_that_the_matcher_cannot_take(library, coder, run):
    """Such runs are one match but for their last character; merging one match is the library's own work."""
    whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=library._mergeable_ranks, special_tokens={})
    ids = coder.encode("x" + run + "y 1")
    assert ids.tolist() == library.encode_ordinary("x") + whole.encode_ordinary(run[:-1]) + library.encode_ordinary(run[-1] + "y 1")
    assert coder.encode(run).tolist() == whole.encode_ordinary(run)
    assert coder.decode(ids) == ("x" + run + "y 1").encode()


def test_op11(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.op11_tiktoken(spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_odd_rows(odd, empty, library):
    found = tiktoken_bpe.decode(tiktoken_bpe.encode(odd)).collect()
    told = sorted((r["doc_id"] or 0, bytes(r["raw"]).decode()) for r in found)
    assert told == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.select("doc_id", "text").collect())
    assert all(np.array_equal(r["ids"], library.encode_ordinary(bytes(r["raw"]).decode())) for r in found)
    assert tiktoken_bpe.encode(empty).collect() == [] and tiktoken_bpe.decode(tiktoken_bpe.encode(empty)).collect() == []


def test_bytes_of_a_part_of_a_character(spark, library):
    ids = library.encode_ordinary("🙂")
    table = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r["raw"]) for r in tiktoken_bpe.decode(table).orderBy("doc_id").collect()] == [library.decode_bytes(ids[:1]), b"", b""]
