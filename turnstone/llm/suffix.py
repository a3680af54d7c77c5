"""Suffix-array dedup on bytes by difference-cover blockwise construction (operator 10).

Every byte that lies in a string of DEPTH bytes which also starts earlier
(smaller doc_id, or same document and smaller offset) is removed.  So the
suffixes are to be sorted by their first DEPTH bytes, and those that tie with one
before them found.

1. Sieve: two equal strings of DEPTH bytes share a pair of cover positions modulo
   PERIOD, from which DEPTH - PERIOD + 1 bytes are equal too.  Suffixes not near a
   cover position whose hash of these bytes occurs twice tie with nothing and are
   not sorted.  (Unlike hashes prove unlike strings; like ones prove nothing here.)
2. Buckets: what is left goes to the bucket of its minimiser, the least hash of
   SEED bytes within its DEPTH bytes, so that equal strings share a bucket and
   neighbours mostly do; a run of neighbours travels as one string.  A block sends
   of strings that it holds twice, byte by byte, just the first.
3. One bucket at a time: the suffixes at the bucket's cover positions are sorted
   by RANKED bytes and ranked, with the length that neighbours in this order have in
   common.  Then the suffixes that are not alone in their hash of DEPTH bytes are
   sorted by their first bytes.  Long ties are settled by ranks: two suffixes have a
   shift of less than PERIOD at which both are at cover positions, and PERIOD bytes on
   they are again, and the ranks there, to what is left of DEPTH bytes, tell whether
   they are equal.  Memory is bounded by the bucket, and no equality rests on a hash.

Results on odd input: null and empty texts have no bytes (n_bytes 0, nothing
removed, the hash of the empty string); rows that repeat a doc_id are ordered by
the MD5 of their text; a null doc_id counts as the smallest.  Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import exchange as X
from .common import buffer, table, total_bytes, worker_cache

DEPTH = 100
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)  # a perfect difference set: every residue but 0 is one difference
HEAD, FIRST = 64, 16  # bytes compared directly (at least PERIOD - 1), and how many of them a bucket is sorted by
RANKED = PERIOD - 1  # bytes that cover suffixes are sorted by
SEED = 24
ROUNDS = 4  # of settling by ranks; then by bytes
BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1_500_000
BUCKET_BYTES = 2 << 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def symbols() -> np.ndarray:
    """A fixed random odd 64-bit number for each byte."""
    return X.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(X.ODD)) | np.uint64(1)


class Block:
    """A block's documents in order, as one run of bytes."""

    def __init__(self, docs):
        docs = docs.combine_chunks().sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        if docs["doc_id"].null_count:  # they sort last, but count as the smallest
            import pyarrow as pa
            import pyarrow.compute as pc

            none = pc.is_null(docs["doc_id"])
            docs = pa.concat_tables([docs.filter(none), docs.filter(pc.invert(none))])
        self.ids, self.number = docs["doc_id"], docs["block"][0].as_py()
        self.data, self.offsets = buffer(docs["text"])
        self.roll = X.Rolling(symbols()[self.data])
        self.n = len(self.data)
        held = worker_cache()
        if held.get("cover") is None or len(held["cover"]) < self.n + PERIOD:
            held["cover"] = np.resize(np.isin(np.arange(PERIOD), COVER), self.n + PERIOD)
        self.sampled = np.zeros(self.n, bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            self.sampled[a:b] = held["cover"][: b - a]

    def fits(self, mask: np.ndarray, width: int) -> np.ndarray:
        """Positions of a mask from which width bytes of the document are left."""
        mask = mask.copy()
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            mask[max(a, b - width + 1) : b] = False
        return np.flatnonzero(mask)

    def spread(self, starts: np.ndarray, before: int, after: int) -> np.ndarray:
        """A mask of [start - before, start + after) around each start."""
        near = np.bincount(np.maximum(starts - before, 0), minlength=self.n + 1) - np.bincount(np.minimum(starts + after, self.n), minlength=self.n + 1)
        return np.cumsum(near[:-1]) > 0


def sample(block: Block, bits: int):
    width = DEPTH - PERIOD + 1
    at = block.fits(block.sampled, width)
    key = block.roll.at(at, width) >> np.uint64(64 - bits) << np.uint64(64 - bits)
    return at, key, *np.unique(key, return_counts=True)


def ties(block: Block, bits: int, replies, buckets: int) -> np.ndarray:
    """The suffixes that may tie to DEPTH bytes, as a mask: those near cover suffixes that tie."""
    at, key, keys, _ = sample(block, bits)
    tied = at[X.answered(replies, 0, len(keys), keys, buckets)[np.searchsorted(keys, key)]]
    return block.spread(tied, PERIOD - 1, 1)


def leaders(keys: np.ndarray) -> np.ndarray:
    """The first place of each key, by as many of its bits as leave room for a place beside them: of unlike keys some share one."""
    room = np.uint64(max(1, len(keys)).bit_length())
    packed = np.sort(keys >> room << room | np.arange(len(keys), dtype=np.uint64))
    at, group = (packed & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64), packed >> room
    begin = np.concatenate([[True], group[1:] != group[:-1]])[: len(at)]
    out = np.empty(len(keys), np.int64)
    out[at] = at[begin][np.cumsum(begin) - 1]
    return out


def same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Whether width bytes from each left are those from its right; neighbours are compared in one go."""
    n = len(left)
    if not n:
        return np.zeros(0, bool)
    head = np.concatenate([[True], (np.diff(left) != 1) | (np.diff(right) != 1)])
    starts = np.flatnonzero(head)
    sizes = np.diff(np.concatenate([starts, [n]])) + width - 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    unlike = np.concatenate([[0], np.cumsum(data[np.repeat(left[starts], sizes) + place] != data[np.repeat(right[starts], sizes) + place])])
    first = np.repeat(at[:-1], np.diff(np.concatenate([starts, [n]]))) + np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    return unlike[first + width] == unlike[first]


def minimisers(roll: X.Rolling, n: int, at: np.ndarray) -> np.ndarray:
    """The least hash of SEED bytes within the DEPTH bytes from each of the places at."""
    span, m = DEPTH - SEED + 1, n - SEED + 1
    h = np.full(-(-m // span) * span, np.iinfo(np.uint64).max, np.uint64)
    h[:m] = X.mix((roll.sums[SEED:] - roll.sums[:-SEED]) * roll.back[:m])
    up = np.minimum.accumulate(h.reshape(-1, span), axis=1).ravel()
    down = np.minimum.accumulate(h.reshape(-1, span)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[at], up[at + span - 1])


class Asked:
    """What a block asks: starts that tie with an earlier one of the block (own), and runs of neighbours for the buckets, in order of bucket, then place."""

    def __init__(self, block: Block, near: np.ndarray, buckets: int):
        rest = block.fits(near, DEPTH)
        lead = leaders(block.roll.at(rest, DEPTH))
        again = lead < np.arange(len(rest))
        again[again] = same_bytes(block.data, rest[again], rest[lead[again]], DEPTH)
        self.own, sent = rest[again], rest[~again]
        if not len(sent):
            self.starts = self.sizes = self.bucket = np.zeros(0, np.int64)
            return
        to = (X.mix(minimisers(block.roll, block.n, sent)) % np.uint64(buckets)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(sent) != 1) | (np.diff(to) != 0)]))
        order = np.argsort(to[begin], kind="stable")
        self.starts, self.bucket = sent[begin][order], to[begin][order]
        self.sizes = np.diff(np.concatenate([begin, [len(sent)]]))[order]

    def request(self, block: Block):
        import pyarrow as pa

        ends = np.flatnonzero(np.concatenate([self.bucket[1:] != self.bucket[:-1], [True]])) + 1 if len(self.bucket) else []
        rows, lo = [], 0
        for hi in ends:
            sizes = self.sizes[lo:hi] + DEPTH - 1
            place = np.repeat(self.starts[lo:hi] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            rows.append((int(self.bucket[lo]), block.number, self.sizes[lo:hi].astype("<u4").tobytes(), block.data[place].tobytes()))
            lo = hi
        bucket, number, sizes, texts = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(number, pa.int32()), "keys": pa.array(sizes, pa.binary()), "more": pa.array(texts, pa.binary())})

    def later(self, replies) -> np.ndarray:
        """Starts of strings that also start earlier: in this block, or by the buckets' replies in another."""
        found = [self.own]
        for kind, bucket, bits in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["bits"].to_pylist()):
            if kind == 1:
                mine = slice(*np.searchsorted(self.bucket, [bucket, bucket + 1]))
                sizes = self.sizes[mine]
                starts = np.repeat(self.starts[mine] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                found.append(starts[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(starts)).view(bool)])
        return np.concatenate(found)


def shifts() -> np.ndarray:
    """For each two residues the least shift that brings both to a cover position."""
    held = np.isin(np.arange(2 * PERIOD), [c + k for c in COVER for k in (0, PERIOD)])
    both = np.array([[held[a : a + PERIOD] & held[b : b + PERIOD] for b in range(PERIOD)] for a in range(PERIOD)])
    return both.argmax(axis=2)


class Sorted:
    """A bucket's bytes: words at each place, and the cover suffixes near some starts in order with what neighbours have in common."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        wide = np.concatenate([data, np.zeros(DEPTH + 20, np.uint8)])
        self.data, self.words = data, np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(">u8").ravel().astype(np.uint64)
        near = np.bincount(starts, minlength=n + 1) - np.bincount(starts + DEPTH, minlength=n + 1)
        cover = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER) & (np.cumsum(near[:-1]) > 0))
        steps = range(0, RANKED, 8)
        order = cover[np.lexsort([self.words[cover + k] for k in reversed(steps)])]
        self.rank = np.zeros(n, np.int32)
        self.rank[order] = np.arange(len(order))
        self.common = np.full(max(len(order) - 1, 0), RANKED, np.int32)
        open_ = np.arange(len(self.common))
        for k in steps:
            unlike = self.words[order[open_] + k] ^ self.words[order[open_ + 1] + k]
            lead = sum((unlike < np.uint64(1 << (8 * b))).astype(np.int32) for b in range(1, 8))
            done = unlike != 0
            self.common[open_[done]] = k + lead[done]
            open_ = open_[~done]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes whose first FIRST bytes are equal have DEPTH bytes in common: HEAD bytes directly, the rest by ranks."""
        out = np.ones(len(a), bool)
        for k in range(FIRST, HEAD, 8):
            out &= self.words[a + k] == self.words[b + k]
        some = np.flatnonzero(out)
        out[some] = self.tie(a[some], b[some])
        return out

    def tie(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes whose first HEAD bytes are equal have DEPTH bytes in common, by the ranks at their common cover positions."""
        shift, out = SHIFTS[a % PERIOD, b % PERIOD], np.zeros(len(a), bool)
        order = np.argsort(shift.astype(np.uint8), kind="stable")
        ends = np.searchsorted(shift[order], np.arange(PERIOD + 1))
        for d in range(PERIOD):
            some = order[ends[d] : ends[d + 1]]
            if not len(some):
                continue
            x, y = a[some] + d, b[some] + d
            left = DEPTH - d
            held = self.alike(x, y, min(left, RANKED))
            if left > RANKED:  # the byte between two cover positions, and what is left after the second
                held &= self.data[x + RANKED] == self.data[y + RANKED]
                if left > PERIOD:
                    held &= self.alike(x + PERIOD, y + PERIOD, left - PERIOD)
            out[some] = held
        return out

    def alike(self, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
        """Whether cover suffixes have depth bytes in common."""
        kind = np.concatenate([[0], np.cumsum(self.common < depth, dtype=np.int32)])
        return kind[self.rank[x]] == kind[self.rank[y]]


def ties_with_earlier(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of the starts, in order of time, whether the DEPTH bytes there are also those at an earlier one."""
    later = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return later
    lead = leaders(X.Rolling(symbols()[data]).at(starts, DEPTH))
    order = np.flatnonzero(np.bincount(lead, minlength=len(starts))[lead] > 1)  # the others are alone in their hash
    if not len(order):
        return later
    held = Sorted(data, starts[order])
    order = order[np.lexsort([held.words[starts[order] + k] for k in range(FIRST - 8, -1, -8)])]  # stable: equal ones by time
    at = starts[order]
    group = np.cumsum(np.concatenate([[False], np.logical_or.reduce([held.words[at[1:] + k] != held.words[at[:-1] + k] for k in range(0, FIRST, 8)])]))
    for _ in range(ROUNDS):
        if not len(order):
            return later
        first = np.concatenate([[True], group[1:] != group[:-1]])
        ahead = starts[order[np.flatnonzero(first)]][np.cumsum(first) - 1]
        equal = first.copy()
        equal[~first] = held.equal(starts[order[~first]], ahead[~first])
        later[order[equal & ~first]] = True
        order, group = order[~equal], group[~equal]
    if len(order):  # many strings with one beginning: by all bytes after it
        keys = [held.words[starts[order] + DEPTH - 8], *(held.words[starts[order] + k] for k in range(DEPTH - 12 & ~7, FIRST - 8, -8)), group]
        by = np.lexsort(keys)
        same = np.logical_and.reduce([k[by][1:] == k[by][:-1] for k in keys])
        later[order[by[1:][same]]] = True
    return later


SHIFTS = shifts()


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes as kept."""
    total = total_bytes(docs)
    dealt, n_blocks = X.in_order(docs.select("doc_id", "text"), max(2, math.ceil(total / block_bytes)), block_bytes)
    n_sieves, n_buckets = (max(2, math.ceil(x)) for x in (total * len(COVER) / PERIOD / BUCKET_KEYS, total / BUCKET_BYTES))
    bits = min(64, max(32, total.bit_length() + 8))

    def ask_sample(docs):
        block = Block(docs)
        _, _, keys, n = sample(block, bits)
        return X.request(block.number, keys, n_sieves, n > 1, bits)

    def ask_windows(docs, replies):
        if not docs.num_rows:
            return X.request(0, np.zeros(0, np.uint64), n_buckets)
        block = Block(docs)
        return Asked(block, ties(block, bits, replies, n_sieves), n_buckets).request(block)

    def sort_bucket(asked):
        import pyarrow as pa

        asked = asked.sort_by("block")
        sizes = [np.frombuffer(x, "<u4").astype(np.int64) for x in asked["keys"].to_pylist()]
        data = np.frombuffer(b"".join(asked["more"].to_pylist()), np.uint8)
        runs = np.concatenate(sizes)
        begin = np.concatenate([[0], np.cumsum(runs + DEPTH - 1)[:-1]])
        starts = np.repeat(begin - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        later, ends = ties_with_earlier(data, starts), np.cumsum([x.sum() for x in sizes])
        bits = [np.packbits(later[e - x.sum() : e]).tobytes() for e, x in zip(ends, sizes)]
        n = len(sizes)
        return pa.table({"block": asked["block"].combine_chunks(), "kind": pa.array([1] * n, pa.int32()), "bucket": asked["bucket"].combine_chunks(), "bits": pa.array(bits, pa.binary())})

    def finish(docs, replies):
        import pyarrow as pa

        block = Block(docs)
        gone = block.spread(Asked(block, ties(block, bits, replies, n_sieves), n_buckets).later(replies), 0, DEPTH)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = block.offsets[:-1][np.diff(block.offsets) > 0]
        begins[heads] = gone[heads]
        n_gone, n_begun = (np.concatenate([[0], np.cumsum(x)])[block.offsets] for x in (gone, begins))
        stay = ~gone
        kept = [block.data[a:b][stay[a:b]].tobytes() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())]
        return pa.table({
            "doc_id": block.ids.cast(pa.int64()),
            "n_bytes": pa.array(np.diff(block.offsets), pa.int64()),
            "n_removed": pa.array(np.diff(n_gone), pa.int64()),
            "n_spans": pa.array(np.diff(n_begun), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            "kept": pa.array(kept, pa.binary()),
        })

    blocks = dealt.groupBy("block")
    first = X.reply(blocks.applyInArrow(ask_sample, X.REQUEST), 0, False, n_blocks, n_sieves)
    asked = blocks.cogroup(first.groupBy("block")).applyInArrow(ask_windows, X.REQUEST).repartition(n_buckets, "bucket")
    second = asked.groupBy("bucket").applyInArrow(sort_bucket, X.REPLY).repartition(n_blocks, "block")
    return blocks.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finish, f"{OUT}, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT rid, i, md5_number(substr(h, 2 * i - 1, 200)) AS k FROM (SELECT rid, h, unnest(range(1, length(h) // 2 - 98)) AS i FROM t WHERE length(h) >= 200)),
d AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY k ORDER BY rid, i) AS n FROM s) WHERE n > 1),
r AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM d),
g AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
p AS (SELECT rid, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY rid, run),
q AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 1) AS z, row_number() OVER (PARTITION BY rid ORDER BY a DESC) AS last FROM p),
k AS (SELECT t.rid, string_agg(substr(h, 2 * z - 1, 2 * (a - z)), '' ORDER BY a) || max(CASE WHEN last = 1 THEN substr(h, 2 * b - 1) ELSE '' END) AS kept, sum(b - a) AS n, count(*) AS spans FROM q JOIN t USING (rid) GROUP BY t.rid)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(k.n, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.kept, h))) AS kept_sha256
FROM t LEFT JOIN k USING (rid)
"""
