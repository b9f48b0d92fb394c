"""A corpus cleaning pipeline made of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. Classifiers learn
from labelled rows that the stage before has kept, outside the fold that the operator's own query holds out. Texts that lose
a repeated passage keep their other words; no row is dropped for it. The classifier stages cannot be written in SQL,
since they are learned, so there is no ORACLE_SQL; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickspark.llm import common, jaccard_join, packing, quality_net, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches one half go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxicity.training_fold(common.labels(spark, sf_dir))))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under one half go."""
    return quality_net.keep_good(docs, quality_net.fit(docs, quality_net.training_fold(common.labels(spark, sf_dir))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that also start in a document with a smaller id go."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in packed sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: The learned stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is computed once and kept in the checkpoint folder before the next reads it."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
