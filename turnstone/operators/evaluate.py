"""Retrieval evaluation: samples, resumption, accuracy, recall and gain at k."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators.squares import squares, unit_rows


def stratified(rows: DataFrame, kind: str, key: str, most: int = 5, seed: int = 42) -> DataFrame:
    """Up to `most` rows of each kind, in the order of a seeded hash of the key."""
    order = Window.partitionBy(kind).orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def remaining(questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return questions.join(done, key, "left_anti")


def accuracy(judged: DataFrame, kind: str, correct: str) -> DataFrame:
    """Right answers, questions and accuracy of each kind, and of all (a null kind)."""
    return judged.rollup(kind).agg(F.sum(F.col(correct).cast("long")).alias("correct"), F.count("*").alias("questions"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank, label and query_label: each query's k most similar vectors but itself.

    The stated query set meets all rows, in squares that keep k rows of each query."""

    def square(rows, asked):
        import numpy as np
        import pyarrow as pa

        out = [[], [], [], [], []]
        if rows.num_rows and asked.num_rows:
            ids, labels, v = rows["id"].to_numpy(), rows["label"].to_numpy(zero_copy_only=False), unit_rows(rows["embedding"])
            for who, of, u in zip(asked["id"].to_pylist(), asked["label"].to_pylist(), unit_rows(asked["embedding"])):
                s = np.where(ids == who, -1, np.round((1 + v @ u) / 2, 9))
                some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                best = some[np.lexsort((ids[some], -s[some]))[:k]]
                best = best[s[best] >= 0]
                for held, values in zip(out, ([who] * len(best), ids[best].tolist(), s[best].tolist(), labels[best].tolist(), [of] * len(best))):
                    held += values
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("query_id", "id", "similarity", "label", "query_label"), out, kinds)})

    scored = squares(vectors.select("id", "label", "embedding"), queries.select("id", "label", "embedding"), square, "query_id long, id long, similarity double, label int, query_label int")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def at_k(ranked: DataFrame, k: int) -> DataFrame:
    """Of each query: whether a like label is among the k (hit), the share that is (precision), and normalised discounted gain."""
    gain = F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0)
    ideal = sum(1 / math.log2(i + 2) for i in range(k))
    return ranked.groupBy("query_id").agg(F.max(gain).alias("hit"), F.round(F.sum(gain) / k, 6).alias("precision"), F.round(F.sum(gain / F.log2(F.col("rank") + 1)) / ideal, 6).alias("ndcg"))
