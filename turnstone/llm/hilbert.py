"""Sharding along a Hilbert curve (operator 7).

Language, source and size are quantised to BITS bits each, the cell's index on
the Hilbert curve orders the rows, and the order is cut into runs.  Rows that are
near in all three lie in few shards, so a filter on any of them can skip files.
The law is `rows`: shards hold counts at most one apart, whatever the skew.

Rows of equal texts are a group: all take the cell of the group's smallest
doc_id and follow each other in the order, so a group is split only where a cut
falls into it.  Within a cell the order is by text (its MD5), then doc_id.

Ranks come from a range-partitioned sort and one count for each partition; only
those counts reach the driver.

Results on odd input: a null text counts as empty; null language or source has a
cell of its own; null doc_ids sort first; repeated rows get a slot each; an empty
table gives an empty result; with fewer rows than shards some stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes, written

SHARDS = 40
BITS = 5
OWN = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert"}
OVERHEAD = 16  # bytes a row takes besides its text


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """The index on the Hilbert curve of points with integer coordinates below 2**bits (Skilling, 2004)."""
    x = [a.astype(np.int64).copy() for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | ((a ^ turn) >> b & 1)
    return index


def category_bin(column: Column) -> Column:
    """0 for null, else one of the other bins by hash: the same value is always in the same bin."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(column.cast("string")), F.lit(2**BITS - 1)).cast("int") + 1)


def size_bin(size: Column) -> Column:
    """Half octaves; the last bin is open."""
    return F.least(F.lit(2**BITS - 1), F.floor(2 * F.log2(size.cast("double")) - 7)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert (the curve index); with keep, these columns of docs first (of clashing names, the operator's stands)."""

    @F.arrow_udf("int")
    def index(lang, source, size):
        import pyarrow as pa

        return pa.array(hilbert_index([a.to_numpy(zero_copy_only=False) for a in (lang, source, size)], BITS).astype(np.int32))

    text = F.coalesce("text", F.lit(""))
    mine = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (text_bytes() + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("group"), *mine,
        category_bin(F.col("lang")).alias("lang_bin"), category_bin(F.col("source")).alias("source_bin"),
    )
    own = F.struct("doc_id", "lang_bin", "source_bin")
    copies = written(rows.groupBy("group").agg(F.count("*").alias("n"), F.min(own).alias("first")).where("n > 1").drop("n"))  # single texts, the most, need no join
    placed = rows.join(copies, "group", "left").withColumn("first", F.coalesce("first", own)).drop("lang_bin", "source_bin")
    placed = placed.withColumn("hilbert", index("first.lang_bin", "first.source_bin", size_bin(F.col("size")))).drop("first")
    order = ["hilbert", "group", "doc_id"]
    ordered = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("group"))
    part = F.shiftrightunsigned("at", 33)
    counts = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    total, before = sum(r["n"] for r in counts), np.cumsum([0] + [r["n"] for r in counts])
    bounds = ordered.sparkSession.createDataFrame([(int(r["p"]), int(b)) for r, b in zip(counts, before)], "p long, before long")  # a row a partition
    rank = (F.col("before") + F.col("at").bitwiseAND(2**33 - 1)).cast("long")
    total = max(total, 1)
    shard_of = F.expr(f"(rank * {shards}L) div {total}L")
    numbered = ordered.join(F.broadcast(bounds), part.cast("long") == F.col("p")).withColumn("rank", rank).withColumn("shard", shard_of.cast("int"))
    return numbered.select(
        *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep) if c not in OWN),
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
