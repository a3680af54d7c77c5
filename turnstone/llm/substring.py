"""Substring dedup on words by difference-cover anchors (operator 1).

A window of WINDOW words that occurs twice is a match.  With a difference cover
D modulo PERIOD, any two positions i and j have a shift d < PERIOD such that
i + d and j + d are both cover positions; so two equal windows share an equal
anchor of WINDOW - PERIOD + 1 words that begins at a cover position in both.
Only anchors (|D| of PERIOD positions) are compared at first; an anchor that
occurs elsewhere is then extended: just the full windows around it are compared,
over all their words.

Results on odd input: null and empty texts have no words (n_words 0, nothing
removed, the hash of the empty string); rows that repeat a doc_id are documents
of their own and match each other like any others; a null doc_id stays null.
Texts are taken whole.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import exchange as X
from .common import buffer, table, total_bytes

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)  # a perfect difference set: every residue but 0 is one difference
BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1_500_000
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Words:
    """The words of a block's documents, hashed; first: where each document begins in them."""

    def __init__(self, docs):
        import xxhash

        data, offsets = buffer(docs["text"])
        self.bytes, n_docs = data, len(offsets) - 1
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets[:-1]] = True  # a word never goes on in the next document
        before = np.concatenate([[False], word[:-1]]) if len(data) else word
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate([word[1:], [False]]) if len(data) else word
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        raw, known, n = data.tobytes(), {}, len(self.starts)
        hashed = np.empty(n, np.uint64)
        for i, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            w = raw[a:b]
            h = known.get(w)
            if h is None:
                known[w] = h = xxhash.xxh3_64_intdigest(w)
            hashed[i] = h
        self.roll = X.Rolling(hashed)
        self.offset = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        self.n_docs = n_docs


def anchors(words: Words, window: int, bits: int):
    """Starts of the anchors, their keys, and the distinct sorted keys."""
    width = window - PERIOD + 1
    at = np.flatnonzero(np.isin(words.offset % PERIOD, COVER) & (words.left >= width))
    key = words.roll.at(at, width) >> np.uint64(64 - bits) << np.uint64(64 - bits)
    return at, key, *np.unique(key, return_counts=True)


def candidates(words: Words, window: int, at, hit) -> np.ndarray:
    """Starts of the whole windows around the anchors that occur elsewhere."""
    near = np.zeros(len(words.offset) + 1, np.int32)
    np.add.at(near, np.maximum(at[hit] - (PERIOD - 1), at[hit] - words.offset[at[hit]]), 1)
    np.add.at(near, at[hit] + 1, -1)
    return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (words.left >= window))


def removed(words: Words, window: int, starts) -> np.ndarray:
    cover = np.zeros(len(words.offset) + 1, np.int32)
    cover[starts] += 1
    np.add.at(cover, starts + window, -1)
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words, joined by one space, as kept_text."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words at least")
    total = total_bytes(docs)
    n_blocks = max(2, math.ceil(total / block_bytes))
    n_buckets = max(2, math.ceil(total / 6 / BUCKET_KEYS))
    bits = min(64, max(32, total.bit_length() + 10))
    dealt = X.deal(docs.select("doc_id", "text"), n_blocks, block_bytes)

    def ask_anchors(docs):
        words = Words(docs)
        _, _, keys, n = anchors(words, window, bits)
        return X.request(docs["block"][0].as_py(), keys, n_buckets, n > 1, bits)

    def found(words, replies):
        at, key, keys, _ = anchors(words, window, bits)
        hit = X.answered(replies, 0, len(keys), keys, n_buckets)[np.searchsorted(keys, key)]
        starts = candidates(words, window, at, hit)
        key = words.roll.at(starts, window)
        return starts, key, *np.unique(key, return_counts=True)

    def ask_windows(docs, replies):
        if not docs.num_rows:
            return X.request(0, np.zeros(0, np.uint64), n_buckets)
        _, _, keys, n = found(Words(docs), replies)
        return X.request(docs["block"][0].as_py(), keys, n_buckets, n > 1)

    def finish(docs, replies):
        import pyarrow as pa

        docs = docs.combine_chunks()
        words = Words(docs)
        starts, key, keys, _ = found(words, replies)
        hit = X.answered(replies, 1, len(keys), keys, n_buckets)[np.searchsorted(keys, key)]
        gone = removed(words, window, starts[hit])
        raw, kept = words.bytes.tobytes(), []
        counts = np.concatenate([[0], np.cumsum(gone)])[words.first]
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            stay = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([raw[i:j] for i, j in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]))
        return pa.table({
            "doc_id": docs["doc_id"].cast(pa.int64()),
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_removed": pa.array(np.diff(counts), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            "kept_text": pa.array([x.decode() for x in kept], pa.string()),
        })

    by_block = dealt.groupBy("block")
    first = X.reply(by_block.applyInArrow(ask_anchors, X.REQUEST), 0, False, n_blocks, n_buckets)
    second = X.reply(by_block.cogroup(first.groupBy("block")).applyInArrow(ask_windows, X.REQUEST), 1, False, n_blocks, n_buckets)
    return by_block.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finish, f"{OUT}, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT rid, j FROM (SELECT rid, unnest(range(i, i + 35)) AS j FROM d)),
k AS (SELECT p.rid, string_agg(p.ws[p.j], ' ' ORDER BY p.j) AS t, count(*) AS n FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS j FROM w) p LEFT JOIN c ON c.rid = p.rid AND c.j = p.j WHERE c.j IS NULL GROUP BY p.rid)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)
"""
