"""Language-model scoring by context-tree weighting (operator 6).

Texts are bytes, A-Z lower-cased, closed by an end mark.  Each byte is eight
binary decisions; each decision (a prefix of the byte) has a context tree over
the DEPTH bytes before, and each node an estimate of Krichevsky and Trofimov
from its zeros and ones in all training texts.  Weighting mixes a node's own
estimate with its children's, at every depth, by how well each would have coded
the training texts; the weights so found mix the predictions for every text.

Counts stay distributed.  A block of documents sends its distinct (context,
byte) keys with their training counts to the buckets of the last two bytes and a
part, by hash, of the third; a bucket thus owns whole subtrees from depth three
on, and a frequent pair of bytes is spread over PARTS buckets.  What the buckets
add to the nodes of depth two is summed, then that of depth one and the root
(65,280 nodes at most, sent to all); how these three levels mix into a prediction
comes back to the buckets that have the depth-two node, as two numbers, and each
block gets one log-probability for each of its keys.  A word-count baseline goes
through the same exchange.

Results on odd input: a null or empty text is an end mark alone (n_tokens 1);
texts are taken whole; a null doc_id counts as training text with the checksum of
an empty string; rows that repeat a doc_id count one by one; without training
texts every decision has probability one half.
"""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .common import buffer, table

DEPTH = 5  # 8 * (DEPTH + 1) bits of a key and 16 of a row number make 64
PACKED_ROWS = 1 << 16  # blocks of more rows sort their row numbers beside the keys
END = 255  # never a byte of UTF-8; also stands before the first
FOLDS, HELD = 7, 2
BLOCK_BYTES = 3 << 20
BLOCK_ROWS = 30_000
BUCKET_KEYS = 1_000_000
ASK = "bucket int, block int, kind int, keys binary, counts binary"
ANSWER = "block int, kind int, bucket int, values binary"
NODES = "node int, bucket int, n0 long, n1 long, below double"
PARTS = 8
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
GRAMS, WORDS = 0, 1
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
END_WORD = 1


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte each, and eight more for those of 255 and over."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(blob, np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", offset=n)
    return counts


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return half_gamma(n0) + half_gamma(n1) - log_factorial(n0 + n1) - math.log(math.pi)


SMALL = 1024
HALF = np.array([math.lgamma(i + 0.5) for i in range(SMALL)])
FACT = np.array([math.lgamma(i + 1.0) for i in range(SMALL)])


def stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def half_gamma(n: np.ndarray) -> np.ndarray:
    return np.where(n < SMALL, HALF[np.minimum(n, SMALL - 1)], stirling(np.maximum(n, 1) + 0.5))


def log_factorial(n: np.ndarray) -> np.ndarray:
    return np.where(n < SMALL, FACT[np.minimum(n, SMALL - 1)], stirling(n + 1.0))


class Block:
    """A block's rows: their keys (context, byte, row), sorted, and their words."""

    def __init__(self, docs):
        docs = docs.combine_chunks()
        self.ids, self.number, self.n = docs["doc_id"], docs["block"][0].as_py(), docs.num_rows
        self.held = docs["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = buffer(docs["text"])
        data, self.sizes = LOWER[data], np.diff(offsets)
        # DEPTH marks before each text, one after it
        put = np.arange(len(data)) + np.repeat((np.arange(self.n) + 1) * DEPTH + np.arange(self.n), self.sizes)
        padded = np.full(len(data) + self.n * (DEPTH + 1), END, np.uint8)
        padded[put] = data
        row = np.repeat(np.arange(self.n, dtype=np.uint32), self.sizes + DEPTH + 1)
        coded = np.ones(len(padded), bool)
        for i, at in enumerate((offsets[:-1] + np.arange(self.n) * (DEPTH + 1)).tolist()):
            coded[at : at + DEPTH] = False
        key = np.zeros(len(padded), np.uint64)
        for back in range(1, DEPTH + 1):
            key[back:] |= padded[:-back].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back) + 16)
        key |= padded.astype(np.uint64) << np.uint64(16)
        if self.n <= PACKED_ROWS:
            key = np.sort(key[coded] | row[coded].astype(np.uint64))
            self.row = (key & np.uint64(0xFFFF)).astype(np.int64)
        else:
            order = np.argsort(key[coded], kind="stable")
            self.row, key = row[coded][order].astype(np.int64), key[coded][order]
        gram = key >> np.uint64(16)
        self.starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        self.grams = gram[self.starts]
        self.words(data, offsets)

    def words(self, data, offsets):
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        roll = X.Rolling(X.mix(np.arange(1, 257, dtype=np.uint64))[data])
        hashed = X.mix((roll.sums[ends] - roll.sums[starts]) * roll.back[starts] + (ends - starts).astype(np.uint64))
        self.word_row = np.concatenate([np.searchsorted(offsets, starts, side="right") - 1, np.arange(self.n)])
        hashed = np.concatenate([hashed, np.full(self.n, END_WORD, np.uint64)])
        self.word_keys, self.word_at = np.unique(hashed, return_inverse=True)


def gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Each key's bucket, by the two bytes before and a part of the third."""
    pair, third = grams >> np.uint64(8 * (DEPTH - 1)), grams >> np.uint64(8 * (DEPTH - 2)) & np.uint64(255)
    return (X.mix((pair << np.uint64(8) | X.mix(third + np.uint64(1)) % np.uint64(PARTS)) + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


class Trees:
    """The subtrees of one bucket, from its distinct sorted keys and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts

    def level(self, j: int):
        """For the decisions on bit j: depths DEPTH to 3 as (key, n0, n1, log KT, log weighted), and each depth's parents in the next; then each gram's deepest node and bit."""
        byte = self.grams & np.uint64(255)
        bit = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64)
        key = (self.grams >> np.uint64(8) << np.uint64(8)) | (byte >> np.uint64(8 - j) if j else np.uint64(0))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        n1 = np.add.reduceat(self.counts * bit, start)
        n0 = np.add.reduceat(self.counts * (1 - bit), start)
        key = key[start]
        kt = log_kt(n0, n1)
        depths, parents = [(key, n0, n1, kt, kt)], []
        for _ in range(DEPTH - 3):
            key, n0, n1, _, weighted = depths[-1]
            up, which = np.unique((key >> np.uint64(16) << np.uint64(8)) | (key & np.uint64(255)), return_inverse=True)
            n0, n1, below = (np.bincount(which, v, len(up)) for v in (n0, n1, weighted))
            n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
            kt = log_kt(n0, n1)
            depths.append((up, n0, n1, kt, np.logaddexp(kt, below) - math.log(2)))
            parents.append(which)
        return depths, parents, at, bit

    def tops(self):
        """What this bucket adds to the nodes of depth two (the pair of bytes, then the decision): node, n0, n1, sum of weighted log-probabilities below."""
        found = []
        for j in range(8):
            key, n0, n1, _, weighted = self.level(j)[0][-1]
            node = (np.uint64(1) << np.uint64(j)) | (key & np.uint64(255))
            up, which = np.unique((key >> np.uint64(16) << np.uint64(8)) | node, return_inverse=True)
            found.append((up.astype(np.int32), *(np.bincount(which, v, len(up)) for v in (n0, n1, weighted))))
        return [np.concatenate(v) for v in zip(*found)]

    def log10(self, nodes: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Each gram's log-probability; nodes: those of depth two, sorted, and how they and those above turn a prediction from below into the final one: add + times * it."""
        out = np.zeros(len(self.grams))
        for j in range(8):
            depths, parents, at, bit = self.level(j)
            key, n0, n1, _, _ = depths[0]
            one, which = (n1 + 0.5) / (n0 + n1 + 1), None
            for (_, n0, n1, kt, weighted), parent in zip(depths[1:], parents):
                which = parent if which is None else parent[which]
                share = np.exp(np.minimum(0, kt - math.log(2) - weighted))[which]
                one = share * ((n1 + 0.5) / (n0 + n1 + 1))[which] + (1 - share) * one
            node = (key >> np.uint64(8 * (DEPTH - 2)) & ~np.uint64(255)) | (np.uint64(1) << np.uint64(j)) | (key & np.uint64(255))
            top = np.searchsorted(nodes, node.astype(np.int64))
            one = add[top] + times[top] * one
            out += np.log10(np.where(bit == 1, one[at], 1 - one[at]))
        return out


def weighed(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """nodes with share, of the own estimate in the mixture, one, that estimate, and weighted, the log-probability of the mixture."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            n0, n1, below = (batch.column(c).to_numpy() for c in ("n0", "n1", "below"))
            kt = log_kt(n0, n1)
            weighted = np.logaddexp(kt, below) - math.log(2)
            share, one = np.exp(np.minimum(0, kt - math.log(2) - weighted)), (n1 + 0.5) / (n0 + n1 + 1)
            kept = [batch.column(c) for c in (*columns, "n0", "n1")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(share), pa.array(one), pa.array(weighted)], names=[*columns, "n0", "n1", "share", "one", "weighted"])

    return nodes.select(*columns, "n0", "n1", "below").mapInArrow(each, f"{', '.join(c + ' int' for c in columns)}, n0 long, n1 long, share double, one double, weighted double")


def mixtures(tops: DataFrame) -> DataFrame:
    """bucket, node, add and times for each row of tops (NODES): how depth two, depth one and the root mix with what is below."""

    def summed(rows: DataFrame, by: list[str], below: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(below).alias("below"))

    two = weighed(summed(tops, ["node"], "below"), ["node"])
    decision, pair = F.col("node").bitwiseAND(255), F.shiftright("node", 16)
    one = weighed(summed(two.select(pair.alias("byte"), decision.alias("decision"), "n0", "n1", "weighted"), ["byte", "decision"], "weighted"), ["byte", "decision"])
    root = weighed(summed(one, ["decision"], "weighted"), ["decision"])
    high = one.alias("x").join(F.broadcast(root.alias("y")), "decision").select(
        "byte", "decision", (F.col("y.share") * F.col("y.one") + (1 - F.col("y.share")) * F.col("x.share") * F.col("x.one")).alias("a"), ((1 - F.col("y.share")) * (1 - F.col("x.share"))).alias("b"),
    )  # 65,280 rows at most
    whole = two.withColumns({"byte": pair, "decision": decision}).join(F.broadcast(high), ["byte", "decision"])
    mixed = whole.select("node", (F.col("a") + F.col("b") * F.col("share") * F.col("one")).alias("add"), (F.col("b") * (1 - F.col("share"))).alias("times"))
    return tops.select("bucket", "node").join(mixed, "node")


def merged(asked):
    """The requests of a kind: (block, keys, counts) of each, the distinct keys, their summed counts, and where each block's keys are among them."""
    each = []
    for block, keys, counts in zip(asked["block"].to_pylist(), asked["keys"].to_pylist(), asked["counts"].to_pylist()):
        keys = X.unpack(keys) if keys else np.zeros(0, np.uint64)
        each.append((block, keys, unpack_counts(counts, len(keys))))
    every = np.concatenate([k for _, k, _ in each])
    keys = np.unique(every)
    counts = np.zeros(len(keys), np.int64)
    for _, k, c in each:
        counts[np.searchsorted(keys, k)] += c
    return each, keys, counts


def score(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of OUT for each of docs; held_out: a boolean column, true for rows the model doesn't learn from."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("b"), F.count("*").alias("n")).first()
    n_blocks = max(2, math.ceil((size["b"] or 0) / block_bytes), math.ceil(size["n"] / BLOCK_ROWS))
    n_buckets = max(2, math.ceil((size["b"] or 0) / 12 / BUCKET_KEYS))
    dealt = X.deal(docs.select("doc_id", "text", held_out.alias("held_out")), n_blocks, block_bytes, BLOCK_ROWS)

    def ask(docs):
        import pyarrow as pa

        block = Block(docs)
        learnt = (~block.held[block.row]).astype(np.int64)
        counts = np.add.reduceat(learnt, block.starts) if len(block.starts) else np.zeros(0, np.int64)
        to = gram_bucket(block.grams, n_buckets)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(n_buckets + 1))
        words = np.bincount(block.word_at, ~block.held[block.word_row], len(block.word_keys)).astype(np.int64)
        cut = X.cut(block.word_keys, n_buckets)
        rows = []
        for i in range(n_buckets):
            mine = order[ends[i] : ends[i + 1]]
            if len(mine):
                rows.append((i, block.number, GRAMS, X.pack(block.grams[mine]), pack_counts(counts[mine])))
            keys = block.word_keys[cut[i] : cut[i + 1]]  # asked of every bucket, for its totals
            rows.append((i, block.number, WORDS, X.pack(keys) if len(keys) else b"", pack_counts(words[cut[i] : cut[i + 1]])))
        bucket, number, kind, keys, counts = zip(*rows)
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(number, pa.int32()), "kind": pa.array(kind, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def of_kind(asked, kind):
        import pyarrow.compute as pc

        return asked.filter(pc.equal(asked["kind"], kind)).sort_by("block")

    def tops(asked):
        import pyarrow as pa

        number, asked = asked["bucket"][0].as_py(), of_kind(asked, GRAMS)
        node, n0, n1, below = Trees(*merged(asked)[1:]).tops() if asked.num_rows else [np.zeros(0, np.int32)] * 4
        return pa.table({"node": pa.array(node, pa.int32()), "bucket": pa.array([number] * len(node), pa.int32()), "n0": pa.array(n0.astype(np.int64)), "n1": pa.array(n1.astype(np.int64)), "below": pa.array(below.astype(float))})

    def answer(asked, top):
        import pyarrow as pa

        rows = []
        top = top.sort_by("node")
        mixed = [top[c].to_numpy() for c in ("node", "add", "times")]
        bucket = asked["bucket"][0].as_py() if asked.num_rows else 0
        for kind in (GRAMS, WORDS):
            part = of_kind(asked, kind)
            if not part.num_rows:
                continue
            each, keys, counts = merged(part)
            if kind == GRAMS:
                values, head = Trees(keys, counts).log10(mixed[0].astype(np.int64), *mixed[1:]).astype("<f4"), b""
            else:
                values, head = counts.astype("<u8"), struct.pack("<qq", int(counts.sum()), int((counts > 0).sum()))
            for block, k, _ in each:
                rows.append((block, kind, bucket, head + values[np.searchsorted(keys, k)].tobytes()))
        block, kind, bucket, values = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"block": pa.array(block, pa.int32()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "values": pa.array(values, pa.binary())})

    def finish(docs, answers):
        import pyarrow as pa

        if not docs.num_rows:
            return pa.schema([]).empty_table()
        block = Block(docs)
        logs, known = np.zeros(len(block.grams)), np.zeros(len(block.word_keys), np.int64)
        to, cut = gram_bucket(block.grams, n_buckets), X.cut(block.word_keys, n_buckets)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(n_buckets + 1))
        total = distinct = 0
        for kind, i, values in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["values"].to_pylist()):
            if kind == GRAMS:
                logs[order[ends[i] : ends[i + 1]]] = np.frombuffer(values, "<f4")
            else:
                tokens, types = struct.unpack_from("<qq", values)
                total, distinct = total + tokens, distinct + types
                known[cut[i] : cut[i + 1]] = np.frombuffer(values, "<u8", offset=16)
        lengths = np.diff(np.concatenate([block.starts, [len(block.row)]]))
        scores = np.bincount(block.row, np.repeat(logs, lengths), block.n)
        c = known[block.word_at]
        n_tokens = np.bincount(block.word_row, minlength=block.n)
        base = np.bincount(block.word_row, np.log10(c + 1), block.n) - n_tokens * math.log10(total + distinct + 1)
        return pa.table({
            "doc_id": block.ids.cast(pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(np.bincount(block.word_row, c > 0, block.n).astype(np.int64)), "train_tokens": pa.array(np.full(block.n, total), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(scores), "n_bytes": pa.array(block.sizes, pa.int64()), "bits_per_byte": pa.array(-scores / math.log10(2) / (block.sizes + 1)),
        })

    blocks = dealt.groupBy("block")
    asked = blocks.applyInArrow(ask, ASK).repartition(n_buckets, "bucket")
    top = mixtures(asked.groupBy("bucket").applyInArrow(tops, NODES)).repartition(n_buckets, "bucket")
    answers = asked.groupBy("bucket").cogroup(top.groupBy("bucket")).applyInArrow(answer, ANSWER).repartition(n_blocks, "block")
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(finish, OUT)


def op6_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD
    return score(table(spark, sf_dir, "documents"), held)
