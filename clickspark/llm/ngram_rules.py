"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Built from DataFrame functions alone. Tokens are runs of letters and digits or runs of other signs; each token and each pair
of neighbours (the last with nothing) is hashed into one of `BUCKETS` buckets. Two multinomials over the buckets are counted,
one over trusted texts and one over the whole corpus, and smoothed by `SMOOTHING`. A text's score is the sum of the log ratios
of its n-grams divided by their number; it is kept if the base rules pass and the score is at least `THRESHOLD`. The verdict
is a plain comparison of each text with a fixed bound, so it is the same whenever it is taken.

Bounds: the target is counted over all trusted texts, the corpus over all texts; the buckets are a constant. The corpus is counted
without a join. Texts are told from others by a bitmap of `FILTER_BITS` hashes of trusted ids, and only those that it lets pass
meet the ids in an equi-join, which settles the ones that share a hash; a table with far more trusted ids than bits sends more
texts than needed, and counts the same.

Edge cases: null text has no words and fails the base rules; a text without tokens scores 0; without trusted rows all ratios
have the same sign and the threshold is measured against the smoothed target alone; repeated rows are counted and judged each;
a null doc_id is never trusted; other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.1
FILTER_BITS = 1 << 22
LEAST_WORDS, REPEAT_WORDS, MOST_REPEATED = 20, 8, 30

_TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x20\x09-\x0D]+"
_SYMBOLS, _BLANKS = r"[#*$%&|<>]", " \t\n\x0b\x0c\r"


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with a column text.

    A word is repeated if a window of `REPEAT_WORDS` words around it occurs twice or more in the text. Windows are compared by
    hash; only texts in which a hash occurs twice sort their windows to find the places."""
    kept = rows.columns
    text = F.coalesce("text", F.lit(""))
    told = rows.withColumns({
        "_w": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "_l": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""),
        "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)).cast("long"),
    })
    w, line = F.col("_w"), F.col("_l")
    told = told.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("long"),
        "_h": F.transform(w, lambda x: F.xxhash64(x)),
    }).drop("_w", "_l")
    h = F.col("_h")
    window = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(REPEAT_WORDS)))
    windows = F.when(F.size(h) > REPEAT_WORDS, F.transform(F.sequence(F.lit(0), F.size(h) - REPEAT_WORDS), window)).otherwise(F.array().cast("array<bigint>"))
    told = told.withColumn("_x", windows).drop("_h")
    x = F.col("_x")
    placed = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    told = told.withColumn("_p", F.when(F.size(F.array_distinct(x)) < F.size(x), placed)).drop("_x")
    p = F.col("_p")
    same = lambda v, j: F.coalesce(v["v"] == F.get(p, j)["v"], F.lit(False))
    twice = F.filter(p, lambda v, j: F.when(j > 0, same(v, j - 1)).otherwise(F.lit(False)) | same(v, j + 1))
    told = told.withColumn("_r", F.sort_array(F.transform(twice, lambda v: v["i"]))).drop("_p")
    r = F.col("_r")
    gaps = F.transform(r, lambda v, j: F.least(F.coalesce(F.get(r, j + 1) - v, F.lit(REPEAT_WORDS)), F.lit(REPEAT_WORDS)))
    told = told.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda t, g: t + g), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return told.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _token_hashes(text: str = "text") -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _pair(h: Column, x: Column, i: Column) -> Column:
    return _bucket(F.xxhash64(x, F.get(h, i + 1)))


def trusted(labels: DataFrame, label: str = "quality") -> DataFrame:
    """Ids of all rows labelled 1, each once."""
    return labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def _hash_bit(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def id_bitmap(ids: DataFrame) -> Column:
    """The hashes of all ids as a bitmap of 64-bit words, for `may_hold`; its size does not depend on the ids."""
    bit = F.expr("shiftleft(1L, cast(_h & 63 as int))")
    words = ids.select(_hash_bit().alias("_h")).groupBy(F.shiftright("_h", 6).alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    places = ids.sparkSession.range(FILTER_BITS // 64).join(words, F.col("id") == F.col("_w"), "left")
    listed = places.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits")))).alias("_all"))
    return listed.select(F.transform("_all", lambda x: x["_bits"])).scalar()


def may_hold(bitmap: Column) -> Column:
    """True for every row whose doc_id the bitmap was made of, and for a few others."""
    return F.bit_get(F.get(bitmap, F.shiftright(_hash_bit(), 6).cast("int")), _hash_bit().bitwiseAND(F.lit(63)).cast("int")) == 1


def _grams(rows: DataFrame, trusted_rows: bool) -> DataFrame:
    hashed = rows.select(_token_hashes().alias("h"))
    h = F.col("h")
    grams = hashed.select(F.explode(F.concat(F.transform(h, _bucket), F.transform(h, lambda x, i: _pair(h, x, i)))).alias("b"))
    return grams.groupBy("b").agg(F.count("*").alias("n")).withColumn("t", F.lit(trusted_rows))


def log_ratios(docs: DataFrame, target: DataFrame) -> list[float]:
    """The log ratio of target to corpus of every bucket; counts are added up where they arise, and a constant number of rows
    comes to the driver."""
    rows = docs.select("doc_id", "text")
    known = rows.where(F.col("doc_id").isNotNull() & may_hold(id_bitmap(target))).join(target.hint("merge"), "doc_id")
    counts, trusted_counts = [0] * BUCKETS, [0] * BUCKETS
    for b, n, t in _grams(rows, False).unionByName(_grams(known, True)).collect():
        (trusted_counts if t else counts)[b] = n
    log_all = math.log(sum(counts) + SMOOTHING * BUCKETS) - math.log(sum(trusted_counts) + SMOOTHING * BUCKETS)
    return [math.log(t + SMOOTHING) - math.log(n + SMOOTHING) + log_all for n, t in zip(counts, trusted_counts)]


def with_score(rows: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds llr, the log-likelihood ratio for each n-gram of column text."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    told = rows.withColumn("_h", _token_hashes())
    h = F.col("_h")
    both = F.transform(h, lambda x, i: F.get(table, _bucket(x)) + F.get(table, _pair(h, x, i)))
    total = F.aggregate(both, F.lit(0.0), lambda t, v: t + v)
    return told.withColumn("llr", F.when(F.size(h) > 0, total / (2 * F.size(h))).otherwise(F.lit(0.0))).drop("_h")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept, for every row."""
    rows = docs.select("doc_id", "text")
    out = with_score(base_counts(rows), log_ratios(docs, trusted(labels)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD)).drop("text")
