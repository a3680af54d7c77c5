"""SimHash near-dedup by a binary-trie self-join (operator 8).

A document's fingerprint has a bit set where over half of its shingles' XXH64
values have it.  Fingerprints within DISTANCE bits of each other are linked.

The join walks a binary trie over the fingerprints: a pair of nodes is split
into its pairs of children, a pair of unlike children costs one bit of the error
budget, and pairs beyond the budget are pruned with all that is below them.  To
deal the walk out, the 64 bits are cut into DISTANCE + 1 bands: two fingerprints
within the budget agree on one band at least, so each band starts a walk of its
own at the pairs of like band values, over the fingerprints turned so that the
band comes first.  Equal fingerprints are one entry, and a task links what it
finds into stars, so a large group costs links in number of its members.

Results on odd input: null and empty texts, and texts of white space, have
fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; rows that repeat a doc_id are rows of their own with one
component; rows of a null doc_id take part, and are their own component's
smallest only where no other row is in it.  Columns besides doc_id and text are
not read, unless kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, spread_join, table, written
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
LEAF = 24  # fingerprints below which a node's pairs are compared outright
FRONT = 1 << 18  # node pairs expanded at a time
OUT = "doc_id long, fp long"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, size = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([1 + len(w) for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = np.array([size(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def bands(distance: int) -> list[tuple[int, int]]:
    """First bit (from the top) and number of bits of distance + 1 bands."""
    n, at, out = distance + 1, 0, []
    for i in range(n):
        size = 64 // n + (i < 64 % n)
        out.append((at, size))
        at += size
    return out


def turned(fp: np.ndarray, by: int) -> np.ndarray:
    return (fp << np.uint64(by)) | (fp >> np.uint64((64 - by) % 64)) if by else fp


def pairs(values: np.ndarray, head: int, distance: int, found) -> None:
    """Calls found(i, j) with arrays of places of sorted distinct values that agree on their first `head` bits and differ in at most `distance` bits."""
    top = values >> np.uint64(64 - head)
    edges = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    keep = hi - lo > 1
    # a pair of nodes: [a, b) and [c, d) of the values, at a depth, with the bits spent above
    stack = [(head, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(keep.sum(), np.int64))]
    while stack:
        depth, a, b, c, d, spent = stack.pop()
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(depth, *(x[half:] for x in (a, b, c, d, spent))), (depth, *(x[:half] for x in (a, b, c, d, spent)))]
            continue
        small = (np.maximum(b - a, d - c) <= LEAF) | (depth == 64)
        if small.any():
            compare(values, a[small], b[small], c[small], d[small], distance, found)
        a, b, c, d, spent = (x[~small] for x in (a, b, c, d, spent))
        if not len(a):
            continue
        m, n = split(values, a, b, depth), split(values, c, d, depth)
        self_pair = a == c
        parts = [(a, m, c, n, spent, None), (m, b, n, d, spent, None), (a, m, n, d, spent + 1, None), (m, b, c, n, spent + 1, ~self_pair)]
        joined = [[], [], [], [], []]
        for *ranges, cost, only in parts:
            w, x, y, z = ranges
            ok = (x > w) & (z > y) & (cost <= distance) & ~((w == y) & (x - w < 2))
            if only is not None:
                ok &= only
            for into, v in zip(joined, (w, x, y, z, cost)):
                into.append(v[ok])
        stack.append((depth + 1, *(np.concatenate(v) for v in joined)))


def split(values, lo, hi, depth):
    """Where the bit at a depth turns to one within each node."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    first = values[lo]
    mask = ~np.uint64(0) << np.uint64(64 - depth) if depth else np.uint64(0)
    return np.clip(np.searchsorted(values, (first & mask) | bit), lo, hi)


def compare(values, a, b, c, d, distance, found):
    """All pairs of small nodes, outright."""
    n, m = b - a, d - c
    size = n * m
    for lo in range(0, len(a), 4096):
        s = slice(lo, lo + 4096)
        which = np.repeat(np.arange(len(a))[s], size[s])
        at = np.arange(len(which)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        i, j = a[which] + at // m[which], c[which] + at % m[which]
        near = (i < j) | (a[which] != c[which])
        i, j = i[near], j[near]
        near = np.bitwise_count(values[i] ^ values[j]) <= distance
        if near.any():
            found(i[near], j[near])


class Stars:
    """Union-find over places of an array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while True:
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up


def near_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp, signed longs) that join up all within the distance."""
    cuts = bands(distance)
    spark = prints.sparkSession
    keyed = prints.select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.shiftleft("fp", at), 64 - size).cast("int").alias("value")) for k, (at, size) in enumerate(cuts)
    ))).alias("k")).select("fp", "k.band", "k.value")

    def walk(batches):
        import pyarrow as pa

        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if got is not None and got.num_rows:
            fp, band = got["fp"].to_numpy().view(np.uint64), got["band"].to_numpy()
            for k, (at, size) in enumerate(cuts):
                values = np.sort(turned(fp[band == k], at))
                if len(values) > 1:
                    stars = Stars(len(values))
                    pairs(values, size, distance, stars.link)
                    root = stars.roots(np.arange(len(values)))
                    moved = np.flatnonzero(root != np.arange(len(values)))
                    back = turned(values, (64 - at) % 64).view(np.int64)
                    out_a.append(back[moved])
                    out_b.append(back[root[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return keyed.repartition(parts(spark) * 2, "band", "value").mapInArrow(walk, "a long, b long")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(each, OUT)


def near_components(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable by links."""
    prints = written(fingerprints(docs, shingle))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = components(near_links(classes.select("fp"), distance))
    placed = classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    groups = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = written(spread_join(placed, groups, ["component"], "size").select("fp", "component_id", "n"))
    return spread_join(prints, named, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
