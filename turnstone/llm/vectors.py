"""Embedding near-dedup by randomised-rotation binary codes (operator 3).

Vectors are brought to length one and turned by random rotations.  What is stored
for each is its code, the signs of the turned coordinates, and its correction
factor, the product of code and turned vector (Gao and Long, 2024): the product of
one vector's code with another turned vector, over the factor, is an unbiased
estimate of their cosine with a known error, so bounds tell which pairs need an
exact computation, in double precision.

1. Which vectors meet is decided by TABLES groups of further signs: vectors that
   agree on a whole group meet there.  The number of signs follows the number of
   vectors, the number of tables the chance that a pair right at the threshold
   meets nowhere, which is MISS (more alike pairs: far less).  Only codes travel:
   of those that meet, pairs whose CHECK signs differ more than two vectors at the
   threshold would, but for a chance of MISS, are dropped.
2. The vectors that are left in a table are fetched there.  The estimate and its
   bound of SIGMAS errors choose the pairs that are computed exactly.

Equal vectors are one entry with a count.  A pair that meets in several tables is
counted in the first; a task gives sums and star links of what it has found, not
pairs.  Groups of over GROUP vectors are cut into pieces, and each two pieces meet
in a task of their own; should there be more than HEAVY such groups, the smaller of
them stay whole, each no more than its share of HEAVY of all entries.

Results on odd input: vectors that are null, empty or zero, or hold a null or a
non-finite component, link with nothing, as do vectors of different lengths with
each other; rows that repeat a vec_id are vectors of their own, each with its own
links and component; a null vec_id takes part, with kept null.  Columns besides
vec_id and embedding are not read.  Equal vectors are told by 128 bits of hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, table, written
from .components import components
from .near import chunks
from .simhash import Stars

COSINE = 0.95
MISS = 1e-6
SIGMAS = 5.0
SEED = 42
GROUP = 2000
HEAVY = 100_000
CHECK = 128
TASK_ROWS = 40_000
MET = "kind int, a long, b long"
SLIM = np.dtype([("key", "<u8"), ("cid", "<i8"), ("side", "<u1"), ("table", "<u2"), ("check", "<u8", CHECK // 64)])
ALL, LEFT, RIGHT = 0, 1, 2  # sides of a group: all meet all, or left meets right


def plan(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits of a table's key, and tables."""
    bits = int(np.clip(round(math.log2(max(n, 2))) - 9, 4, 32))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def most_differing(cosine: float, miss: float) -> int:
    """As many of CHECK signs differ at most, but for a chance of miss, at the threshold."""
    p = math.acos(cosine) / math.pi
    left, at = 1.0, -1
    while left > miss and at < CHECK:
        at += 1
        left -= math.comb(CHECK, at) * p**at * (1 - p) ** (CHECK - at)
    return at


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """`count` random rotations of dim dimensions, side by side."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(unit: np.ndarray, bits: int, tables: int, seed: int):
    """Each vector's code (signs of dim coordinates, packed), correction factor, CHECK signs (packed), and key in each table."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, 1 + math.ceil((CHECK + bits * tables) / dim), seed)
    signs = turned >= 0
    factor = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
    rest = signs[:, dim : dim + CHECK + bits * tables]
    keys = (rest[:, CHECK:].reshape(len(unit), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
    return np.packbits(signs[:, :dim], axis=1), factor, np.packbits(rest[:, :CHECK], axis=1).view("<u8"), keys


def spread(codes, dim: int) -> np.ndarray:
    """Packed codes as coordinates."""
    return np.where(np.unpackbits(codes, axis=1, count=dim), 1.0, -1.0) / math.sqrt(dim)


def meet(unit, turned, code, factor, keys, left, right, here: int, cosine: float):
    """Linked pairs (i, j) of left and right (places), each of which has its first common table here."""
    dim = unit.shape[1]
    estimate = (code[left] @ turned[right].T) / factor[left][:, None]
    error = np.sqrt((1 - factor[left] ** 2).clip(0)) / factor[left] * SIGMAS / math.sqrt(max(dim - 1, 1))
    i, j = np.nonzero(estimate >= cosine - error[:, None])
    i, j = left[i], right[j]
    out = [], []
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        a, b = a[near], b[near]
        first = (keys[a] == keys[b]).argmax(axis=1) == here
        out[0].append(a[first])
        out[1].append(b[first])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out[0]]), np.concatenate([none, *out[1]])


def by_dim(vectors):
    """(places, matrix) for each length among the rows of a pyarrow list column."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for dim in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == dim)
        yield of, flat[starts[of][:, None] + np.arange(dim)]


def entry_keys(keys: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """One key for each row and table."""
    from . import exchange as X

    table = np.arange(keys.shape[1], dtype=np.uint64) * np.uint64(X.ODD)
    return X.mix(X.mix(keys.astype(np.uint64) + table) + dims.astype(np.uint64)[:, None])


def meet_slim(rows: np.ndarray, most: int):
    """Places of rows (SLIM, sorted by key and side) that are within `most` differing signs of a row they meet."""
    n = np.arange(len(rows))
    ends = np.searchsorted(rows["key"], rows["key"], side="right")
    begins = n + 1
    cross = np.flatnonzero(rows["side"] == LEFT)
    if len(cross):  # left rows meet the right ones of their group, which follow them
        right = np.concatenate([[0], np.cumsum(rows["side"] == RIGHT)])
        begins[cross] = ends[cross] - (right[ends[cross]] - right[cross])
    begins = np.where(rows["side"] == RIGHT, ends, begins)
    later, hit = ends - begins, np.zeros(len(rows), bool)
    for s in chunks(later, 1 << 18):
        a = np.repeat(n[s], later[s])
        b = np.repeat(begins[s], later[s]) + np.arange(len(a)) - np.repeat(np.cumsum(later[s]) - later[s], later[s])
        near = np.bitwise_count(rows["check"][a] ^ rows["check"][b]).sum(axis=1, dtype=np.int64) <= most
        hit[a[near]] = hit[b[near]] = True
    return np.flatnonzero(hit)


def near_vectors(rows: DataFrame, cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable).withColumns({"h0": F.xxhash64(F.lit(0), "embedding"), "h1": F.xxhash64(F.lit(1), "embedding")})
    classes = good.groupBy("h0", "h1").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    count = classes.count()
    bits, tables = plan(count, cosine, miss)
    most, tasks = most_differing(cosine, miss / 10), max(2, math.ceil(count * tables / TASK_ROWS))

    def encoded(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            codes, factor, check, keys, dims = [None] * n, np.zeros(n), [None] * n, [None] * n, np.zeros(n, np.int32)
            for of, v in by_dim(batch.column("embedding")):
                code, f, c, k = encode(units(v), bits, tables, seed)
                factor[of], dims[of] = f, v.shape[1]
                for i, row in enumerate(of.tolist()):
                    codes[row], check[row], keys[row] = code[i].tobytes(), c[i].tobytes(), k[i].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(dims), pa.array(codes, pa.binary()), pa.array(factor), pa.array(check, pa.binary()), pa.array(keys, pa.binary())], names=["cid", "dim", "code", "factor", "check", "keys"])

    codes = written(classes.select("cid", "embedding").mapInArrow(encoded, "cid long, dim int, code binary, factor double, check binary, keys binary"))

    def unpacked(batch):
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<u4").reshape(batch.num_rows, tables)
        return entry_keys(keys, batch.column("dim").to_numpy())

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                keys, n = np.unique(unpacked(batch), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "rows"])

    counted = codes.select("keys", "dim").mapInArrow(sizes, "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows"))
    large = counted.where(F.col("rows") > GROUP).orderBy(F.desc("rows")).limit(HEAVY).collect()  # HEAVY numbers at most
    held = codes.sparkSession.sparkContext.broadcast((np.array(sorted(r["key"] for r in large), np.int64).view(np.uint64), {r["key"] % 2**64: math.ceil(r["rows"] / GROUP) for r in large}))

    def entries(batches):
        import pyarrow as pa

        from . import exchange as X

        heavy, pieces = held.value
        heavy = np.sort(heavy)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = unpacked(batch)
            cid = batch.column("cid").to_numpy()
            check = np.frombuffer(b"".join(batch.column("check").to_pylist()), "<u8").reshape(batch.num_rows, -1)
            out = np.zeros(keys.size, SLIM)
            out["key"], out["cid"], out["check"] = keys.ravel(), np.repeat(cid, tables), np.repeat(check, tables, axis=0)
            out["table"] = np.tile(np.arange(tables), batch.num_rows)
            big = np.isin(out["key"], heavy)
            if big.any():
                some, cut = out[big], []
                for key in np.unique(some["key"]).tolist():
                    mine, m = some[some["key"] == key], pieces[key]
                    at = (X.mix(mine["cid"].astype(np.uint64) + np.uint64(key)) % np.uint64(m)).astype(np.int64)
                    for other in range(m):  # a spot for each two pieces
                        p, q = np.minimum(at, other), np.maximum(at, other)
                        spot = mine.copy()
                        spot["key"] = X.mix(mine["key"] + (p * m + q + 1).astype(np.uint64) * np.uint64(X.ODD))
                        spot["side"] = np.where(p == q, ALL, np.where(at == p, LEFT, RIGHT))
                        cut.append(spot)
                out = np.concatenate([out[~big], *cut])
            to = (out["key"] % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(tasks + 1))
            full = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([out[order[ends[i] : ends[i + 1]]].tobytes() for i in full], pa.binary())], names=["task", "rows"])

    def sift(got):
        import pyarrow as pa

        met = np.concatenate([np.frombuffer(r, SLIM) for r in got["rows"].to_pylist()])
        met = met[np.lexsort((met["cid"], met["side"], met["key"]))]
        left = met[meet_slim(met, most)]
        return pa.table({"key": pa.array(left["key"].astype(np.uint64).view(np.int64)), "side": pa.array(left["side"].astype(np.int32)), "place": pa.array(left["table"].astype(np.int32)), "cid": pa.array(left["cid"])})

    slim = codes.select("cid", "dim", "check", "keys").mapInArrow(entries, "task int, rows binary").repartition(tasks, "task")
    left = written(slim.groupBy("task").applyInArrow(sift, "key long, side int, place int, cid long"))
    full = left.join(classes.select("cid", "n", "embedding"), "cid").join(codes.select("cid", "code", "factor", "keys"), "cid")

    def search(batches):
        import pyarrow as pa

        for got in groups_of(batches):
            yield from linked(got)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["kind", "a", "b"])

    def groups_of(batches):
        """Whole groups of sorted batches, one at a time."""
        import pyarrow as pa

        held = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and hi > lo and held[-1].column("key")[0] != batch.column("key")[lo]:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def linked(got):
        import pyarrow as pa

        cid, n, side = got["cid"].to_numpy(), got["n"].to_numpy(), got["side"].to_numpy()
        unit = units(np.concatenate([v for _, v in by_dim(got["embedding"].chunk(0))]))  # a group is of one length
        dim, here = unit.shape[1], np.arange(len(cid))
        turned = unit @ rotations(dim, 1, seed)
        code = spread(np.frombuffer(b"".join(got["code"].to_pylist()), np.uint8).reshape(len(cid), -1), dim)
        factor, keys = got["factor"].to_numpy(), np.frombuffer(b"".join(got["keys"].to_pylist()), "<u4").reshape(len(cid), -1)
        table = got["place"][0].as_py()
        whole = side[0] == ALL
        left, right = (here, here) if whole else (here[side == LEFT], here[side == RIGHT])
        stars, total = Stars(len(cid)), np.zeros(len(cid), np.int64)
        for x in range(0, len(left), 512):  # a strip of 512 at a time
            i, j = meet(unit, turned, code, factor, keys, left[x : x + 512], here[x:] if whole else right, table, cosine)
            if whole:
                i, j = i[i < j], j[i < j]
            np.add.at(total, i, n[j])
            np.add.at(total, j, n[i])
            stars.link(i, j)
        hit, root = np.flatnonzero(total), stars.roots(here)
        moved = np.flatnonzero(root != here)
        kinds = np.repeat(np.array([0, 1], np.int32), [len(hit), len(moved)])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([cid[hit], cid[moved]])), pa.array(np.concatenate([total[hit], cid[root[moved]]]))], names=["kind", "a", "b"])

    met = full.repartition(tasks, "key").sortWithinPartitions("key", "side", "cid")
    found = written(met.mapInArrow(search, MET))
    others = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    joined = components(found.where("kind = 1").select("a", "b"))
    placed = classes.select("h0", "h1", "cid", "n", "least").join(others, "cid", "left").join(joined, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    known = written(spread_join(placed, named, ["component"], "size").select("h0", "h1", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = spread_join(good.select("vec_id", "h0", "h1"), known, ["h0", "h1"], "n").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m USING (vec_id)
"""
