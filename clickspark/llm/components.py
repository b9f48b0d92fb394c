"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a key in one part, and keys, the most frequent ones, that are dealt into parts.
PART_ROWS, MOST_HEAVY = 1000, 8192

#: Edges that a task reads at least where there are more tasks than the session runs at once.
TASK_ROWS = 1_000_000


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """heavy, parts: the `MOST_HEAVY` most frequent keys among those with more than `PART_ROWS` rows, and the parts that their rows
    are dealt into. Any other key has less than an 8192nd of all rows."""
    counted = rows.groupBy(F.col(key).alias("heavy")).agg(F.count("*").alias("n")).where((F.col("n") > PART_ROWS) & F.col("heavy").isNotNull())
    return cut(counted.orderBy(F.desc("n"), "heavy").limit(MOST_HEAVY).select("heavy", F.ceil(F.col("n") / PART_ROWS).alias("parts")))


def with_totals(rows: DataFrame, key: str, other: str, totals: dict[str, Column], heavy: DataFrame | None = None) -> DataFrame:
    """Adds to each row the totals (aggregates) of all rows of its key.

    Rows are added up where they are before they meet. The rows of a heavy key are dealt into parts by column `other`, and
    each part gets the totals once; those of all other keys stay together. `heavy` is from `heavy_keys`, of these rows or of
    rows that have each key at least as often; it has at most `MOST_HEAVY` rows and is broadcast."""
    heavy = F.broadcast(heavy_keys(rows, key) if heavy is None else heavy)
    whole = rows.groupBy(F.col(key).alias("_key")).agg(*(total.alias(name) for name, total in totals.items()))
    whole = whole.join(heavy, F.col("_key") == F.col("heavy"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("heavy", "parts")
    dealt = rows.join(heavy, F.col(key) == F.col("heavy"), "left").withColumn("_own", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0))).drop("heavy", "parts")
    return dealt.join(whole, (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_part"))).drop("_key", "_part", "_own")


def _gathered(rows: DataFrame, n: int) -> DataFrame:
    """The same rows, some n, read in fewer tasks if there are few."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))


def _pair(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _each(rows: DataFrame, *pairs: Column) -> DataFrame:
    """All pairs of each row, from one reading of it."""
    return rows.select(F.explode(F.array(*pairs)).alias("_pair")).select("_pair.a", "_pair.b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: every node of an edge (a, b) with the smallest node of its component; a root stands for itself too.

    Each step joins nodes to the smallest of their neighbours, found by a combined aggregate, so no neighbour list is built.
    Both halves of a step are computed once, and no step is taken once all components are stars around their smallest node.
    Loops and repeated edges are allowed; edges with a null end are ignored."""
    least = {"m": F.min("b")}
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        n, stars = _told(now)
        now = _gathered(now, n)
        if stars:
            break
        both = _each(now, _pair("a", "b"), _pair("b", "a"))
        heavy = heavy_keys(both, "a")  # neither step gives a key more rows
        both = with_totals(both, "a", "b", least, heavy)
        large = _gathered(cut(both.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()), n)
        small = with_totals(large, "a", "b", least, heavy)
        now = cut(_each(small, _pair("a", "m"), _pair("b", "m")).where("a <> b").distinct())
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _told(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: each larger end has one edge, and is no smaller end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    n, apart = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up"))), 1))).first()
    return n, not apart
