"""Document fingerprints: one-permutation MinHash with optimal densification, as packed low-order bits.

Built from DataFrame functions alone. Each word shingle is hashed once; the hash's high bits choose one of `BINS` bins and the
smallest hash of a bin represents it. All bins of a text come from one sort: a sentinel closes each bin, so the first value of
each run is the bin's minimum, or the sentinel if the bin is empty. An empty bin copies a bin that hashing (bin, attempt)
chooses, attempt after attempt until a bin that was filled is found; after `ATTEMPTS` the rest are tried in a fixed scrambled
order. Of each bin the low eight bits are kept, as two hexadecimal digits. Chance agreement of eight bits, 1/256, is taken
out of the share of equal bins.

Edge cases: null text counts as empty; a text without words has a fingerprint of zeros; a text of one to four words has one
shingle, all its words; equal texts have equal fingerprints whatever their ids; rows that share a doc_id are ordered by their
text; null ids come last in descending order, by a hash of their text and then by text; a table of one row is its own neighbour; an empty table gives no rows; other
input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

SHINGLE_WORDS, BINS, BIN_BITS, KEPT_BITS, ATTEMPTS = 5, 256, 8, 8, 24

#: Text in a bucket of neighbouring documents, the most buckets, whose bounds the driver holds, and the most parts of each bucket,
#: whose bounds are found and sent without it: at most MOST_BUCKETS * MOST_PARTS values.
BUCKET_BYTES, MOST_BUCKETS, MOST_PARTS, BOUNDS_A_LIST = 16 << 20, 8192, 64, 64

#: Null ids are placed below this value, spread by a hash; smaller ids share it as their place.
_LOWEST = -(1 << 62)

_SHIFT = 63 - BIN_BITS
_CLOSED = (1 << _SHIFT) - 1


def _array(values: list[int], kind: str) -> Column:
    """A constant array, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, the kept bits of all bins of column `text` as array<tinyint>. Each step names what the next one uses more
    than once, so that nothing is computed twice."""
    kept = rows.columns
    hashed = rows.withColumn("_h", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    h, n = F.col("_h"), F.size("_h")
    shingle = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE_WORDS))).bitwiseAND(F.lit((1 << 63) - 1))
    shingles = (
        F.when(n >= SHINGLE_WORDS, F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), shingle))
        .when(n > 0, F.array(F.xxhash64(h).bitwiseAND(F.lit((1 << 63) - 1))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    ends = _array([((b + 1) << _SHIFT) - 1 for b in range(BINS)], "bigint")
    ordered = hashed.withColumn("_s", F.sort_array(F.concat(shingles, ends)))
    s = F.col("_s")
    lowest = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)))
    bits = F.transform(lowest, lambda x: F.when(x.bitwiseAND(F.lit(_CLOSED)) != _CLOSED, x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int")))
    binned = ordered.withColumn("_m", bits)
    m = F.col("_m")

    def attempt(i: Column, a: int) -> Column:
        """The bin that hashing (i, a) chooses."""
        return F.get(m, (i * ((2 * a + 1) * 37 % BINS | 1) + (a * a * 91 + 53 * a + 17) % BINS).bitwiseAND(F.lit(BINS - 1)))

    def last(i: Column) -> Column:
        tried = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.get(m, i.bitwiseXOR((k * 167 + 13).bitwiseAND(F.lit(BINS - 1)))))
        return F.get(F.filter(tried, lambda v: v.isNotNull()), F.lit(0))

    filled = F.transform(m, lambda x, i: F.coalesce(x, *(attempt(i, a) for a in range(1, ATTEMPTS + 1)), F.when(n > 0, last(i)), F.lit(0)))
    return binned.withColumn(out, F.transform(filled, lambda v: (v - 128).cast("tinyint"))).select(*kept, out)


def as_text(bits: Column) -> Column:
    """The packed bits as hexadecimal digits."""
    digits = F.split(F.lit(",".join(f"{v:02x}" for v in range(1 << KEPT_BITS))), ",")
    return F.array_join(F.transform(bits, lambda v: F.get(digits, v.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, without what chance makes equal."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    chance = 1.0 / (1 << KEPT_BITS)
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance))


def with_next(rows: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", prepare=lambda df: df) -> DataFrame:
    """Adds next_<column> of the row that follows in descending order of key; the first row follows the last. `prepare` adds
    costly columns to rows once their neighbours are known.

    Rows are dealt into buckets of neighbouring keys by quantiles, and these into parts where a table has more than `MOST_BUCKETS`
    buckets of text. Each also gets the first row of the one after it, so that no window spans the whole table and texts are
    shuffled once."""
    spark = rows.sparkSession
    spread = F.shiftright(F.xxhash64(text), 2) + F.lit((1 << 61) - (1 << 63))
    place = F.when(F.col(key).isNull(), spread).otherwise(F.greatest(F.col(key), F.lit(_LOWEST)))
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    bounds = rows.agg(F.percentile_approx(place, [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets)).first()[0] or []
    bounds = sorted(set(bounds))
    lists = [bounds[a : a + BOUNDS_A_LIST] for a in range(0, len(bounds), BOUNDS_A_LIST)] or [[]]
    lead = _array([x[0] for x in lists if x], "bigint") if bounds else F.array().cast("array<bigint>")
    told = F.split(F.lit(";".join(",".join(map(str, x)) for x in lists)), ";")
    coarse = rows.withColumn("_place", place).withColumn("_list", F.greatest(F.size(F.filter(lead, lambda b: b < F.col("_place"))) - 1, F.lit(0)))
    inner = F.size(F.filter(F.split(F.get(told, F.col("_list")), ",").cast("array<bigint>"), lambda b: b < F.col("_place"))) if bounds else F.lit(0)
    dealt = coarse.withColumn("_bucket", F.col("_list") * BOUNDS_A_LIST + inner).drop("_list")
    parts = min(MOST_PARTS, -(-size // (BUCKET_BYTES * buckets)))
    if parts > 1:
        finer = dealt.groupBy("_bucket").agg(F.percentile_approx("_place", [i / parts for i in range(1, parts)], 100 * parts).alias("_bounds"))
        below = F.size(F.filter("_bounds", lambda b: b < F.col("_place")))
        dealt = dealt.join(F.broadcast(finer), "_bucket").withColumn("_bucket", F.col("_bucket") * parts + below).drop("_bounds")

    heads = dealt.groupBy("_bucket").agg(F.max("_place").alias("_place"))
    down = Window.orderBy(F.desc("_bucket"))
    wanted = heads.select("_place", F.coalesce(F.lag("_bucket").over(down), F.min("_bucket").over(Window.partitionBy())).alias("_to"))
    extra = dealt.drop("_bucket").join(F.broadcast(wanted), "_place")
    one = F.row_number().over(Window.partitionBy("_to").orderBy(F.desc(key), text))
    extra = extra.withColumn("_one", one).where("_one = 1").drop("_one").withColumnRenamed("_to", "_bucket")
    both = prepare(dealt).withColumn("_extra", F.lit(False)).unionByName(prepare(extra).withColumn("_extra", F.lit(True)))
    order = Window.partitionBy("_bucket").orderBy("_extra", F.desc("_place"), F.desc(key), text)
    out = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_extra"))
    return out.drop("_bucket", "_place", "_extra")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars (code points), bits: the fingerprint of every row."""
    return with_fingerprint(_rows(docs), "text", "bits")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, bits, edited_bits, near_edited, near_next: every row against its text with the second half
    replaced by the beginning of the next document, and against that document."""
    rows = with_next(_rows(docs), ["text", "bits"], prepare=lambda df: with_fingerprint(df, "text", "bits"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited).drop("text", "next_text"), "edited", "edited_bits")
    near = {"near_edited": likeness(F.col("bits"), F.col("edited_bits")), "near_next": likeness(F.col("bits"), F.col("next_bits"))}
    return rows.withColumns(near).drop("next_bits")
