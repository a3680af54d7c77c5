"""What several operators share: tables, scratch space, Arrow text buffers, worker caches."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.sources import scratch


#: Most rows and bytes of a batch that goes to a Python worker: rows are whole texts, and 10,000 of them can be a gigabyte.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH; smaller settings stay."""
    for key, most in BATCH.items():
        found = str(spark.conf.get(key)).removesuffix("b")
        if not found.isdigit() or not 0 < int(found) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files go as soon as what read them is written, and not when the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return scratch.written(df)
    finally:
        spark.conf.set(CLEANUP, before)


#: Classes of more rows than this are joined by broadcast, the largest HOTTEST of them.
HOT, HOTTEST = 500, 1000


def spread_join(rows: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows.join(classes, keys) where classes has each key once and, as size, how many rows have it.

    The largest classes, HOTTEST at most, go to all tasks, so that their rows need no shuffle; what is left of a key is
    no more than its share of HOTTEST of all rows."""
    hot = written(classes.where(F.col(size) > HOT).orderBy(F.desc(size)).limit(HOTTEST))
    if hot.isEmpty():
        return rows.join(classes, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(classes, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


#: Bits of the bitmap that sifted sends to all tasks: 524,288 rows of 64 at most, whatever the number of keys.
SIEVE = 1 << 25


def sifted(rows: DataFrame, at: list[Column], keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose columns `at` may be among the keys', and those that surely are not.

    Told by one bit of a hash, so all rows with a partner are in the first, and of the others one in SIEVE over the number
    of keys.  What follows can then join the first alone, and the second, whole texts mostly, needs no shuffle."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(SIEVE))
    place = F.pmod(F.xxhash64(*at), F.lit(SIEVE))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    words = written(keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")))
    met = (words["word"] == F.shiftright(place, 6)) & (F.getbit(words["bits"], place.bitwiseAND(63).cast("int")) == 1)
    return rows.join(F.broadcast(words), met, "left_semi"), rows.join(F.broadcast(words), met, "left_anti")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, whatever functions are unpickled in it."""
    held = sys.modules.setdefault("_turnstone_worker_cache", types.ModuleType("_turnstone_worker_cache"))
    return held.__dict__.setdefault("held", {})


def text_bytes(column="text") -> Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return int(docs.agg(F.sum(text_bytes(column).cast("long")).alias("b")).first()["b"] or 0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a pyarrow string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    import pyarrow as pa

    joined = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if hasattr(column, "chunks") else column.cast(pa.large_string())
    joined = joined.fill_null("") if joined.null_count else joined
    if not len(joined):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lower_ascii(text: bytes) -> bytes:
    """Lower-cases A-Z and nothing else; bytes.lower() does just that."""
    return text.lower()
