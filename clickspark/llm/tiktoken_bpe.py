"""Byte-level BPE by the tiktoken library with a local rank file, and decoding to raw bytes.

A long text is cut at safe boundaries and encoded part by part. A place is safe if the splitting pattern ends a match there
whatever stands around it: after a letter or digit that a character of another kind follows, or before white space that
follows anything else. Only characters that have been letters, digits, punctuation or blanks in every edition of the
character tables are looked at, so a cut never depends on which edition the library was built with. A run of white space
that is too long for the library's matcher is handed over as one match, but for its last character, which goes with what
follows it. Long runs of letters need no cut: the library merges them in about linear time.

Edge cases: null text counts as empty and has no ids; ids that stand for part of a character decode to those bytes; special
tokens are plain text; rows that repeat are encoded each on its own; a null doc_id is kept; other input columns are ignored;
an empty table gives no rows. Decoding fails on an id that the rank file does not have.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import steps

#: Characters of a part of a long text, of a run of white space that is one match, and ids that are decoded at once.
PART, LONG_RUN, DECODED = 1 << 16, 100_000, 1 << 18

#: The 25 characters of white space, letters and digits of old standing, and characters that are neither.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0905-\u0939\u0e01-\u0e30\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGIT = "0-9"
_OTHER = r"!-/:-@\[-`{-~" + "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"

_SAFE = regex.compile(rf"(?<=[{_LETTER}])(?=[{_BLANK}{_DIGIT}{_OTHER}])|(?<=[{_DIGIT}])(?=[{_BLANK}{_LETTER}{_OTHER}])|(?<=[^{_BLANK}])(?=[{_BLANK}])")
_RUN = regex.compile(rf"(?<![{_BLANK}])[{_BLANK}]{{{LONG_RUN},}}+")

_ENCODINGS: dict[tuple[str, str], tiktoken.Encoding] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoding of a rank file, made once a process."""
    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text in order, cut at the first safe place after each `size` characters; without such a place it stays whole."""
    at = 0
    while len(text) - at > size and (found := _SAFE.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Coder:
    """Texts to ids and ids to bytes."""

    def __init__(self, path: str, pattern: str):
        self.plain, self.whole = encoding(path, pattern), encoding(path, r"(?s:.+)")

    def _short(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, unsigned 32-bit."""
        if len(text) <= PART:
            return self._short(text)
        out, at = [], 0
        for run in [*_RUN.finditer(text)]:
            upto = run.end() - (run.end() < len(text))
            out += map(self._short, parts(text[at : run.start()]))
            out.append(self.whole.encode_to_numpy(text[run.start() : upto], disallowed_special=()))
            at = upto
        out += map(self._short, parts(text[at:]))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.plain.decode_bytes(ids[i : i + DECODED].tolist()) for i in range(0, len(ids), DECODED))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids, a list of all ids of a text. With `decoded` also raw, the bytes that the ids stand for, read back from the
    ids where they were made. The rank file must have the same place on every machine."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        for batch in steps(batches):
            ids = [coder.encode(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            columns, names = [batch.column("doc_id"), _lists(ids)], ["doc_id", "ids"]
            if decoded:
                columns.append(pa.array([coder.decode(i) for i in ids], pa.binary()))
                names.append("raw")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", raw binary" * decoded)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and raw, the bytes that the ids stand for; a null list counts as empty."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        for batch in batches:
            raw = [coder.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, raw binary")
