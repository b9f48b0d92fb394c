"""Token counts by section: whole texts are encoded once and each token is attributed to a section by its characters.

A section is a run of characters of one field; a field's lines are its sections, each with the line break that ends it, so
sections cover the text without gaps. The fields of a document are encoded together, joined by a line break that belongs to
the field before it. Token spans and sections are both sorted, so the interval join is a merge within the document.

A token that crosses a boundary is allocated to the section that holds most of its characters, and to the first of these if
several hold equally many. Every token is thus counted once.

Edge cases: a null field counts as empty; an empty document has one section, without tokens; a text that ends in a line break
has no further section after it; a token that is a part of one character has that character as its span; rows that repeat are
counted each on its own; input columns besides doc_id and the fields are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, packing
from .common import steps

_COUNTS = "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long"


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and last character + 1 of each token."""
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(lead)])
    ends = np.cumsum(sizes[ids])
    return upto[ends - sizes[ids] + 1] - 1, upto[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary; section i is bounds[i] to bounds[i + 1]."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    best, most = first.copy(), np.minimum(ends, bounds[first + 1]) - starts
    crossing = np.flatnonzero(last > first)
    at = first[crossing] + 1
    while len(crossing):
        held = np.minimum(ends[crossing], bounds[at + 1]) - bounds[at]
        better = held > most[crossing]
        best[crossing[better]], most[crossing[better]] = at[better], held[better]
        going = at < last[crossing]
        crossing, at = crossing[going], at[going] + 1
    return best, last > first


def _bounds(text: str) -> list[int]:
    """Ends of the lines of a text."""
    out, at = [], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out if out and out[-1] == len(text) else [*out, len(text)]


def count_tokens(docs: DataFrame, fields: Sequence[str] = ("text",), path: str | None = None) -> DataFrame:
    """doc_id, field, section, start, end (characters of the field), n_tokens, n_crossing: one row for each section. n_crossing
    counts the section's tokens that reach into another section."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.vocabulary(path)
        sizes = np.array([len(t) for t in own.tokens], np.int64)
        for batch in steps(batches, fields[0]):
            rows, names, numbers, begins, stops, counts, crossings = [], [], [], [], [], [], []
            columns = [batch.column(f).to_pylist() for f in fields]
            for row, parts in enumerate(zip(*columns)):
                parts = [p or "" for p in parts]
                whole = "\n".join(parts)
                bounds, at = [0], 0
                for k, (name, part) in enumerate(zip(fields, parts)):
                    own_bounds = _bounds(part)
                    begins += [0, *own_bounds[:-1]]
                    stops += own_bounds
                    names += [name] * len(own_bounds)
                    numbers += range(len(own_bounds))
                    bounds += [at + b for b in own_bounds]
                    at += len(part) + 1
                    if k + 1 < len(parts):
                        bounds[-1] += 1
                n = len(bounds) - 1
                rows += [row] * n
                if whole:
                    start, end = token_spans(whole, np.array(packing._ids(path, whole), np.int64), sizes)
                    best, crossing = attribute(start, end, np.array(bounds))
                    counts.append(np.bincount(best, minlength=n))
                    crossings.append(np.bincount(best[crossing], minlength=n))
                else:
                    counts.append(np.zeros(n, np.int64))
                    crossings.append(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(begins, pa.int64()), pa.array(stops, pa.int64()),
                    pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(crossings).astype(np.int64)),
                ],
                ["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    return docs.select("doc_id", *(F.col(f).cast("string").alias(f) for f in fields)).mapInArrow(run, _COUNTS)
