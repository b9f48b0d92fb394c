"""Similarity self-join on word shingles: MinHash buckets, Bayesian pruning of candidates, exact verification.

1. Equal texts are one class from the start; the smallest doc_id stands for them and carries their number.
2. Each text gets MinHash values; a bucket is a band of equal values. Buckets of one text are dropped at once. Of buckets with
   the same members one is kept; members are the same if their number, the smallest, the largest, and two independent 64-bit
   hashes of all of them are.
3. Inside a bucket, MinHash values are compared a step at a time. With a uniform prior the similarity is Beta(m + 1, n - m + 1)
   after m of n values agreed; a pair is dropped once the posterior probability of reaching the threshold is under
   `TOLERANCE`. Pairs that last join clusters, of which only one edge a member leaves the task.
4. Clusters are merged over all buckets. Every text of a cluster meets every other one exactly once, in blocks, where their
   shingle sets are intersected. Links are counted there; again only one edge a member leaves.

With 32 bands of 4 values a pair at the threshold of 0.8 shares no bucket with probability 5e-8, and less if it is closer.

Memberships travel as ids; MinHash values (256 bytes a text) and shingle sets are fetched by id where they are compared. A large
bucket or cluster is dealt into blocks of bounded size, in texts and in shingles, so no task holds more than two. Members that
are likely similar to the bucket's pivot are one cluster already; members within half the allowed distance of a cluster's root
are all linked to each other, because Jaccard distance is a metric. Such core members are counted, not compared: only the
others meet all blocks. Joins that meet all rows of one bucket or text have plain shuffles on both sides, which AQE may split.

Edge cases: null text counts as empty; texts without a word are linked to equal texts alone; texts of one to four words have
one shingle, all their words; rows that share a doc_id are separate documents of one id, and different texts of one id are
compared like any others; a null doc_id has the class of its text but is never compared; an empty table gives no rows; input
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, row_of, signed, steps, text_bytes, window_hashes, word_hashes, word_spans
from .components import components, with_totals

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_VALUES, STEP, TOLERANCE = 32, 4, 16, 1e-6
VALUES = BANDS * BAND_VALUES

#: Texts in a block that compares MinHash values, texts and shingles in one that compares shingle sets.
BUCKET_BLOCK, CLUSTER_BLOCK, BLOCK_SHINGLES = 4096, 512, 2_000_000

#: Of each smallest hash 16 bits are kept; two texts agree in them by chance once in 65,536 times.
_VALUE = np.uint16
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, and each text's first one (one more entry than texts)."""
    data, at = text_bytes(texts)
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    hashes, begin = window_hashes(words, first, SHINGLE_WORDS)
    rows, n = row_of(first, begin), np.diff(first)
    for size in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(n == size)
        if len(short):
            whole = mix(words[first[short]] + np.uint64(size))
            for k in range(1, size):
                whole = mix(whole * np.uint64(31) + words[first[short] + k])
            hashes, rows = np.concatenate([hashes, whole]), np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return hashes[order], np.searchsorted(rows[order], np.arange(len(n) + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        hashes, first = shingles(batch.column("text"))
        size = np.diff(first)
        full = np.flatnonzero(size)
        values = np.empty((len(full), VALUES), _VALUE)
        if len(full):
            for k, seed in enumerate(_SEEDS):
                values[:, k] = mix(np.minimum.reduceat(hashes * seed, first[full])) >> np.uint64(48)
        raw = [None] * batch.num_rows
        for i, v in zip(full.tolist(), values):
            raw[i] = v.tobytes()
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(raw, pa.binary()), pa.array(size)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "values", "size"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _VALUE).reshape(-1, VALUES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = _matrix(batch.column("values")).reshape(-1, BANDS, BAND_VALUES).astype(np.uint64)
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2])
        for k in range(BAND_VALUES):
            keys = mix(keys * np.uint64(0x100000001B3) + values[:, :, k])
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), batch.column("rep").take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))], ["bucket", "rep"])


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of n equal values that leave a posterior of at least `tolerance`: P(J >= t) = P(Binomial(n + 1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_LEAST = [(upto, least_matches(upto)) for upto in range(STEP, VALUES + 1, STEP)]


def _likely(values: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of the others whose values, compared step by step with those of i, are never too unlike."""
    agreed = np.zeros(len(others), np.int64)
    for upto, least in _LEAST:
        agreed += (values[others, upto - STEP : upto] == values[i, upto - STEP : upto]).sum(1)
        alive = agreed >= least
        others, agreed = others[alive], agreed[alive]
        if not len(others):
            break
    return others


class Clusters:
    """Clusters of the rows of a block, as one label a row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        found = np.unique(self.label[np.append(others, i)])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]


_EDGES = "a long, b long"


def _edges(ids: np.ndarray, clusters: Clusters) -> pa.Table:
    """Each row with the smallest id of its cluster; rows alone are left out."""
    _, group = np.unique(clusters.label, return_inverse=True)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    root = least[group]
    other = root != ids
    return pa.table({"a": pa.array(ids[other]), "b": pa.array(root[other])})


def _prune(key: tuple, block: pa.Table) -> pa.Table:
    ids, side = block.column("rep").to_numpy(), block.column("side").to_numpy()
    values = _matrix(block.column("values"))
    clusters, crossing = Clusters(len(ids)), key[1].as_py() != key[2].as_py()
    for i in range(len(ids)):
        apart = clusters.label != clusters.label[i]
        if crossing:
            apart &= side != side[i]
        others = np.flatnonzero(apart)
        if len(others) and len(others := _likely(values, i, others)):
            clusters.join(i, others)
    return _edges(ids, clusters)


def _blocks(members: DataFrame, group: str, most: dict[str, int]) -> DataFrame:
    """Members (rep, group, core and the columns of `most`) of large groups dealt into blocks that hold about so much of each
    column. Blocks of members outside the core meet each other and all core blocks; core blocks do not meet, since what holds
    among them is known."""
    totals = {f"_{c}{k}": F.sum(F.when(F.col("core") == k, F.col(c)).otherwise(0)) for c in most for k in (True, False)}
    told = with_totals(members, group, "rep", totals)
    blocks = lambda k: F.greatest(*(F.ceil(F.col(f"_{c}{k}") / limit) for c, limit in most.items()), F.lit(0).cast("long"))
    told = told.withColumn("_r", blocks(False)).withColumn("_c", blocks(True)).where("_r > 0")
    place = lambda n: F.pmod(F.xxhash64("rep", group), F.greatest(n, F.lit(1)))
    own = F.when(F.col("core"), F.col("_r") + place(F.col("_c"))).otherwise(place(F.col("_r")))
    upto = F.when(F.col("core"), F.col("_r")).otherwise(F.col("_r") + F.col("_c"))
    told = told.withColumn("_own", own).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
    side = F.when(F.col("_own") == F.least("_o", "_own"), 0).otherwise(1)
    return told.select("rep", group, F.least("_o", "_own").alias("i"), F.greatest("_o", "_own").alias("j"), side.alias("side"))


def _alone(members: DataFrame, group: str) -> DataFrame:
    """Members of groups that fit in one block."""
    zero = F.lit(0).cast("long")
    return members.select("rep", group, zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"))


def _with_head(members: DataFrame, group: str, head: str, blocks: Column, known: DataFrame, value: str) -> DataFrame:
    """Members with `value` of their own and head_<value> of the group's head, from `known` (rep and value). The head is sent
    once to each of a group's `blocks` parts."""
    part = members.withColumn("_blocks", blocks.cast("long")).withColumn("_part", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    heads = members.where(F.col("rep") == F.col(head)).select(group, "rep", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("_part"))
    heads = heads.join(known.select("rep", F.col(value).alias(f"head_{value}")), "rep").drop("rep")
    return part.join(known, "rep").join(heads, [group, "_part"]).drop("_blocks", "_part")


def _core(batches: Iterator[pa.RecordBatch], column: str, told) -> Iterator[pa.RecordBatch]:
    """Replaces a column and the head's by core, what `told` says of the two."""
    for batch in batches:
        core = told(batch.column(column), batch.column(f"head_{column}"))
        kept = batch.drop_columns([column, f"head_{column}"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(core, pa.bool_())], [*kept.schema.names, "core"])


def _near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Core are members likely similar to the bucket's pivot."""

    def told(own: pa.Array, head: pa.Array) -> np.ndarray:
        equal = np.cumsum(_matrix(own) == _matrix(head), 1)
        return np.all([equal[:, upto - 1] >= least for upto, least in _LEAST], 0)

    return _core(batches, "values", told)


def _near_root(threshold: float):
    """Core are members within half the allowed distance of the cluster's root. Jaccard distance is a metric, so any two such
    members are at or over the threshold."""
    half = (1.0 + threshold) / 2.0

    def told(own: pa.Array, head: pa.Array) -> list[bool]:
        core = []
        for raw, root in zip(own.to_pylist(), head.to_pylist()):
            a, b = np.frombuffer(raw, np.uint64), np.frombuffer(root, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            core.append(both >= half * (len(a) + len(b) - both))
        return core

    return lambda batches: _core(batches, "set", told)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        hashes, first = shingles(batch.column("text"))
        raw = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(raw, pa.binary())], ["rep", "set"])


_LINKS = "rep long, root long, n_links long, n_text_links long"


def _verify(threshold: float):
    def run(key: tuple, block: pa.Table) -> pa.Table:
        ids, side, copies = (block.column(c).to_numpy() for c in ("rep", "side", "copies"))
        sets = [np.frombuffer(s, np.uint64) for s in block.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        crossing = key[1].as_py() != key[2].as_py()
        clusters, links, texts = Clusters(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        mark = np.zeros(flat.max() + 1, np.int64)
        for i in range(len(ids)):
            own = flat[first[i] : first[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], first)
            mark[own] = 0
            linked = both >= threshold * (sizes + sizes[i] - both) - 1e-9
            linked[i] = False
            if crossing:
                linked &= side != side[i]
            found = np.flatnonzero(linked)
            links[i], texts[i] = copies[found].sum(), len(found)
            if len(found):
                clusters.join(i, found)
        roots = dict(zip(*(_edges(ids, clusters).column(c).to_pylist() for c in ("a", "b"))))
        return pa.table({"rep": pa.array(ids), "root": pa.array([roots.get(i, i) for i in ids.tolist()], pa.int64()), "n_links": pa.array(links), "n_text_links": pa.array(texts)})

    return run


def _key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _own_nodes(classes: DataFrame) -> tuple[DataFrame, bool]:
    """Adds id, the smallest doc_id, while rep becomes a node that no other text has: the id, unless it is another text's too;
    then all but the first text get a hash of their key. Also whether any did."""
    shared = cut(classes.where("rep is not null").groupBy("rep").agg(F.count("*").alias("_k"), F.min("key").alias("_first")).where("_k > 1").select("rep", "_first"))
    if shared.isEmpty():
        return classes.withColumn("id", F.col("rep")), False
    node = F.when(F.col("key") != F.col("_first"), F.xxhash64("key", "rep")).otherwise(F.col("rep"))
    return cut(classes.join(shared, "rep", "left").select("key", node.alias("rep"), F.col("rep").alias("id"), "copies", "values", "size")), True


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_copies, n_links, n_text_links: one row for each document. class_id is the smallest doc_id of its
    connected component; n_links counts other documents at or over the threshold, equal texts included; n_text_links counts
    different texts."""
    ends, _ = _classes(docs, threshold)
    out = docs.select("doc_id", _key().alias("key")).join(cut(ends.select("key", "class_id", "copies", "links", "texts")), "key")
    return out.select(
        "doc_id", "class_id", F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"),
    )


def _buckets(compared: DataFrame) -> DataFrame:
    """bucket, rep, n and pivot: the members of each bucket of two or more, of buckets with the same members one alone."""
    banded = compared.select("rep", "values").mapInArrow(_bands, "bucket long, rep long")
    repeated = cut(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(banded.join(repeated.hint("merge"), "bucket"))
    who = [F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")]
    same = members.groupBy("bucket", "n").agg(*who).groupBy("n", "pivot", "last", "x", "y").agg(F.min("bucket").alias("bucket"))
    kept = cut(same.select("bucket", "pivot"))
    return members.join(kept.hint("merge"), "bucket").select("bucket", "rep", "n", "pivot")


def _likely_edges(compared: DataFrame) -> DataFrame:
    """a, b: edges that join all pairs of a bucket which survive pruning."""
    values, buckets = compared.select("rep", "values"), cut(_buckets(compared))
    met, near = _alone(buckets.where(F.col("n") <= BUCKET_BLOCK), "bucket"), None
    large = buckets.where(F.col("n") > BUCKET_BLOCK)
    if not large.isEmpty():  # else the plan needs no branch for them
        told = _with_head(large, "bucket", "pivot", F.ceil(F.col("n") / BUCKET_BLOCK), values, "values").select("bucket", "rep", "pivot", "values", "head_values")
        large = cut(told.mapInArrow(_near_pivot, "bucket long, rep long, pivot long, core boolean"))
        met = met.unionByName(_blocks(large.withColumn("one", F.lit(1)), "bucket", {"one": BUCKET_BLOCK}))
        near = large.where("core and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    likely = met.join(values.hint("merge"), "rep").groupBy("bucket", "i", "j").applyInArrow(_prune, _EDGES)
    return likely if near is None else likely.unionByName(near)


def _checked(docs: DataFrame, compared: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """rep, root, n_links, n_text_links: links that hold, by the block in which they were found."""
    sized = clusters.join(compared.select(F.col("rep").alias("node"), "id", "key", "copies", "size").hint("merge"), "node").withColumnRenamed("node", "rep")
    blocks = F.ceil(F.greatest(F.col("n") / CLUSTER_BLOCK, F.col("w") / BLOCK_SHINGLES))
    inside = cut(with_totals(sized, "root", "rep", {"n": F.count("*"), "w": F.sum("size")}).withColumn("blocks", blocks))
    texts = docs.select("doc_id", "text", _key().alias("_key"))
    texts = texts.join(inside.select("rep", "id", "key").hint("merge"), (texts.doc_id == F.col("id")) & (texts._key == F.col("key"))).select("rep", "text")
    sets = texts.mapInArrow(_sets, "rep long, set binary").dropDuplicates(["rep"])
    met, large = _alone(inside.where("blocks <= 1"), "root"), inside.where("blocks > 1").select("rep", "root", "size", "copies", "blocks")
    known = None
    if not large.isEmpty():
        sets = cut(sets)
        told = _with_head(large, "root", "root", F.col("blocks"), sets, "set").select("rep", "root", "size", "copies", "set", "head_set")
        large = cut(told.mapInArrow(_near_root(threshold), "rep long, root long, size long, copies long, core boolean"))
        met = met.unionByName(_blocks(large.withColumn("one", F.lit(1)), "root", {"one": CLUSTER_BLOCK, "size": BLOCK_SHINGLES}))
        core = with_totals(large.where("core"), "root", "rep", {"all_copies": F.sum("copies"), "all_texts": F.count("*")})
        known = core.select("rep", "root", (F.col("all_copies") - F.col("copies")).alias("n_links"), (F.col("all_texts") - 1).alias("n_text_links"))
    met = met.join(inside.select("rep", "copies").hint("merge"), "rep").join(sets.hint("merge"), "rep")
    found = met.groupBy("root", "i", "j").applyInArrow(_verify(threshold), _LINKS)
    return cut(found if known is None else found.unionByName(known))


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """key, copies, class_id, links and texts of each different text, and key and id of the text that stands for each class; the
    id is null where only rows without one have the text."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands are laid out for thresholds of {THRESHOLD} or more")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    signed_rows = keyed.mapInArrow(_signatures, "doc_id long, key string, values binary, size long")
    told = [F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("values").alias("values"), F.max("size").alias("size")]
    classes, hashed = _own_nodes(cut(signed_rows.groupBy("key").agg(*told)))
    compared = classes.where("rep is not null and size > 0")
    clusters = cut(components(_likely_edges(compared)))
    checked = _checked(docs, compared, clusters, threshold)

    joined = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = checked.groupBy("rep").agg(F.sum("n_links").alias("links"), F.sum("n_text_links").alias("texts"))
    ends = classes.select("key", "rep", "id", "copies").join(joined, F.col("rep") == F.col("node"), "left").drop("node").join(counts, "rep", "left")
    ends = ends.withColumn("root", F.coalesce("root", "rep"))
    if not hashed:
        return ends.withColumn("class_id", F.col("root")), ends.where("rep = root or rep is null").select("key", "id")
    least = ends.where("rep is not null").groupBy("root").agg(F.min(F.struct("id", "key")).alias("least"))
    ends = cut(ends.join(least, "root", "left").withColumn("class_id", F.col("least.id")))
    return ends, ends.where("rep is null or key = least.key").select("key", "id")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all columns: of the smallest doc_id, and of its texts the one that stands for the class.
    Texts that only rows without an id have are classes of their own. Of rows that share both id and text one stays. All
    columns travel in one, so that no name of theirs meets one used here."""
    _, heads = _classes(docs, threshold)
    row = F.concat_ws(":", _key(), F.col("doc_id").cast("string")).alias("row")
    held = docs.select(row, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"))
    repeated = held.groupBy("row").agg(F.count("*").alias("n")).where("n > 1")
    heads = cut(heads.select(F.concat_ws(":", "key", F.col("id").cast("string")).alias("row")).join(repeated, "row", "left"))
    kept = held.join(heads.hint("merge"), "row")
    once = kept.where("n is null").select("held.*")
    if heads.where("n > 1").isEmpty():
        return once
    return once.unionByName(kept.where("n > 1").dropDuplicates(["row"]).select("held.*"))
