"""Asking the whole corpus about keys, block by block.

Documents are dealt into blocks of a few megabytes.  A block sends each of its
distinct 64-bit keys once, sorted and delta-coded, to the bucket that owns the
key's range; the bucket sees every block's keys and answers with one bit for
each.  Only blobs are shuffled, a hot key costs one entry a block, and neither
the driver nor any task ever holds a whole key group's rows.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, written

REQUEST = "bucket int, block int, keys binary, more binary"
REPLY = "block int, kind int, bucket int, bits binary"
ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Polynomial hashes, modulo 2**64, of any window of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(n, ODD), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(n, pow(ODD, -1, 2**64))

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.back[starts] + np.uint64(width))


def pack(keys: np.ndarray) -> bytes:
    """Distinct sorted keys as the first one and deltas of as many bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return struct.pack("<BQ", width, int(keys[0])) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width, first = struct.unpack_from("<BQ", blob)
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(raw) + 1, 8), np.uint8)
    full[1:, :width] = raw
    steps = full.view("<u8").ravel()
    steps[0] = first
    return np.cumsum(steps, dtype=np.uint64)


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted keys: buckets + 1 places."""
    starts = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


def request(block: int, keys: np.ndarray, buckets: int, flags: np.ndarray | None = None, bits: int = 64):
    """The rows that ask about a block's distinct sorted keys, of which only the top bits are set; flags: one bit each to go along."""
    import pyarrow as pa

    at = cut(keys, buckets)
    full = [i for i in range(buckets) if at[i + 1] > at[i]]
    return pa.table({
        "bucket": pa.array(full, pa.int32()),
        "block": pa.array([block] * len(full), pa.int32()),
        "keys": pa.array([pack(keys[at[i] : at[i + 1]] >> np.uint64(64 - bits)) for i in full], pa.binary()),
        "more": pa.array([b"" if flags is None else np.packbits(flags[at[i] : at[i + 1]]).tobytes() for i in full], pa.binary()),
    })


def no_reply():
    import pyarrow as pa

    return pa.table({"block": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})


def answered(replies, kind: int, n: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits for a block's n sorted keys, from its replies of one kind."""
    out, at = np.zeros(n, bool), cut(keys, buckets)
    for k, bucket, bits in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["bits"].to_pylist()):
        if k == kind:
            m = at[bucket + 1] - at[bucket]
            out[at[bucket] : at[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=m).view(bool)
    return out


def reply(requests: DataFrame, kind: int, earlier: bool, n_blocks: int, n_buckets: int) -> DataFrame:
    """A bit for each key asked: it occurs elsewhere too (in another block, or flagged as repeated in its own), or with earlier, in a block of a smaller number."""

    def bucket(asked):
        import pyarrow as pa

        asked = asked.sort_by("block")
        keys = [unpack(x) for x in asked["keys"].to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")  # merges the blocks' sorted runs; within a key, by block
        put = every[order]
        same = np.zeros(len(put) + 1, bool)
        same[1:-1] = put[1:] == put[:-1]
        hit = np.zeros(len(every), bool)
        if earlier:
            hit[order] = same[:-1]
        else:
            own = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).view(bool) if m else np.zeros(len(k), bool) for m, k in zip(asked["more"].to_pylist(), keys)])
            hit[order] = same[:-1] | same[1:]
            hit |= own
        bits = [np.packbits(hit[e - len(k) : e]).tobytes() for e, k in zip(ends, keys)]
        n = len(keys)
        return pa.table({"block": asked["block"].combine_chunks(), "kind": pa.array([kind] * n, pa.int32()), "bucket": asked["bucket"].combine_chunks(), "bits": pa.array(bits, pa.binary())})

    asked = requests.repartition(n_buckets, "bucket")
    return asked.groupBy("bucket").applyInArrow(bucket, REPLY).repartition(n_blocks, "block")


def deal(docs: DataFrame, n_blocks: int, block_bytes: int, block_rows: int = 30_000) -> DataFrame:
    """docs (doc_id, text and more) with a column block, by a hash of doc_id and text, every time alike; if equal rows would fill a block, by a hash of a written row number."""
    columns, key = docs.columns, F.xxhash64("doc_id", "text")
    equal = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(text_bytes().cast("long")).alias("b"))
    if not equal.where((F.col("n") > block_rows) | ((F.col("n") > 1) & (F.col("b") > block_bytes))).isEmpty():
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()))
        key = F.xxhash64("row")
    return docs.withColumn("block", F.pmod(key, F.lit(n_blocks)).cast("int")).select(*columns, "block").repartition(n_blocks, "block")


GRAIN = 8  # cells of the order for each block


def in_order(docs: DataFrame, n_blocks: int, block_bytes: int) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with tie, the text's MD5, and block, which grows with (doc_id, tie), and the number of blocks; a null doc_id counts as the smallest.

    Blocks are runs of about block_bytes.  GRAIN bounds a block come to the driver, and the bytes between them."""
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    wanted = [i / (GRAIN * n_blocks) for i in range(1, GRAIN * n_blocks)]
    found = docs.select(F.percentile_approx(at, wanted, max(10_000, 20 * n_blocks)).alias("b")).first()["b"] or []
    often = {a for a, b in zip(found[:-1], found[1:]) if a == b}  # ids of many rows have a cell of their own
    bounds = np.array(sorted({*found, *(x + 1 for x in often if x < 2**63 - 1)}), np.int64)

    @F.pandas_udf("int")
    def cell(key):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    held = docs.select(at.alias("at"), text_bytes().cast("long").alias("b")).groupBy(cell("at").alias("cell")).agg(F.sum("b").alias("b")).collect()
    sizes = np.zeros(len(bounds) + 1, np.int64)
    for r in held:
        sizes[r["cell"]] = r["b"]
    alone = np.zeros(len(sizes), bool)
    alone[np.searchsorted(bounds, np.array(sorted(often), np.int64), side="right")] = True
    parts = np.where(alone, np.maximum(1, -(-sizes // block_bytes)), 1)  # a cell of one id is cut by tie
    base, used, block = np.zeros(len(sizes), np.int64), 0, 0
    for i in range(len(sizes)):
        if i and (parts[i] > 1 or parts[i - 1] > 1 or used + sizes[i] > block_bytes):
            block, used = block + int(parts[i - 1]), 0
        base[i], used = block, used + sizes[i]

    @F.pandas_udf("int")
    def block_of(key, tie):
        import pandas as pd

        c = np.searchsorted(bounds, key.to_numpy(), side="right")
        first = tie.str.slice(0, 8).map(lambda x: int(x, 16)).to_numpy(np.int64) if len(tie) else np.zeros(0, np.int64)
        return pd.Series((base[c] + (first * parts[c] >> 32)).astype(np.int32))

    n = int(base[-1] + parts[-1])
    tied = docs.withColumn("tie", F.md5(F.coalesce("text", F.lit(""))))
    return tied.withColumn("block", block_of(at, F.col("tie"))).repartition(n, "block"), n
