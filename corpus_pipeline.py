"""From documents to a training corpus: five stages, each a whole-table operator.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and reread as the next one's docs.  All but the last give the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import decontam, hilbert, mixing, near, quality
from turnstone.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.  It learns from all labels of documents that are still there."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies: those that operator 8 links, and those of similarity 0.8 in five-word shingles."""
    return near.remove_near_copies(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of any benchmark item."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins sources out to the target weights: four fifths of all tokens, no document twice."""
    return mixing.mixed(docs, share=0.8, max_epochs=1)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts each document into a shard and slot."""
    return hilbert.shard(docs, keep=tuple(docs.columns))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmarks),
    ("mixing to target weights", target_weights),
    ("sharding", shards),
]
ORACLE_SQL = None  # a classifier and SimHash are no SQL: tests/llm holds it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else written(docs)
    return docs
