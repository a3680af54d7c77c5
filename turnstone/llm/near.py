"""Near copies by Jaccard similarity of word shingles, found by wide SimHashes (operator 8's fingerprints, longer and for a lower similarity).

Documents whose sets of SHINGLE-word shingles have a Jaccard similarity of
SIMILARITY at least are linked; one of each linked group stays.

1. Documents of equal shingle sets are one class.
2. Sketches of few shingles have dependent bits, so classes of fewer than FEW
   shingles are found exactly: those that share one of their rarest shingles (as
   many as no partner can do without) and whose sizes allow the similarity form
   groups.  Classes of up to FEW / SIMILARITY shingles take part, as their
   partners may be larger.
   Each class of FEW and more has a SimHash of as many bits as are needed: its
   shingles' signed count sketch, turned at random (signs, then a Hadamard transform), bit by sign.
   Sets of similarity 0.8 differ in 15 % of the bits.  CHECK bits are compared;
   the others form bands, and classes that agree on a whole band meet there.  A
   band's bits grow with the logarithm of the number of classes; the number of
   bands follows the chance MISS that a pair right at the threshold meets nowhere.
   Those that meet and are within LOOSE of the CHECK bits form loose groups: first
   by FIRST bands, then by the others, where what is joined up already is neither
   compared nor linked again.  So a large group of near copies is not linked anew
   in each band, nor are all its pairs compared in any.
3. Within a group of either kind similarities are exact.  Groups of over PIECE classes are
   cut into pieces.  First the classes of each piece are compared, then the first
   class of each component so found with those of the other pieces.  What has
   become one component needs nothing more; if others are left beside the largest
   one, each of their classes is compared with all classes of the group, piece by
   piece.  So a large group of near copies costs rows in number of its members,
   and no link is lost.

Results on odd input: null and empty texts have no shingles and are one class;
texts of fewer words than a shingle have one shingle; rows that repeat a doc_id
are each compared, and stay or go by their own text (of rows alike in both, one
stays); rows of a null doc_id stay.  Equal texts and shingle sets are told by 128
bits of hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.sources import scratch

from . import exchange as X
from .common import parts, sifted, spread_join, written
from .components import components
from .simhash import DISTANCE, Stars, fingerprint, near_links

SHINGLE = 5
SIMILARITY = 0.8
MISS = 1e-6
FEW = 64
SKETCH = 2048
CHECK, LOOSE = 128, 40  # at similarity 0.8 19.5 bits differ, five deviations more make 40; unlike sets differ in 64
FIRST = 8  # bands of the first round
MANY = 256  # classes that meet in a band, beyond which not all their pairs are compared outright
STEP = 64  # sketches turned at a time
PIECE = 400
TASK_ENTRIES = 100_000
UNIT = ["doc_id", "t0", "t1"]  # a document: its id and its text


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), xxhash.xxh3_64_intdigest
    ends = np.cumsum([1 + len(w) for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = (starts[: len(words) - shingle + 1], ends[shingle - 1 :]) if len(words) > shingle else (starts[:1], ends[-1:])
    return np.unique(np.array([size(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))


def plan(n: int, similarity: float, miss: float) -> tuple[int, int]:
    """Bits of a band, and bands."""
    bits = int(np.clip(round(math.log2(max(n, 2))) - 4, 8, 40))
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A signed count sketch; the weights differ a little, so that no sums come out even."""
    h = X.mix(hashes)
    weight = np.where(h >> np.uint64(63), 1.0, -1.0) * (1 + (h >> np.uint64(40) & np.uint64(0xFFFF)).astype(np.float64) / 2**19)
    return np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), weight, SKETCH)


def signs(sketches: np.ndarray, bits: int) -> np.ndarray:
    """As many random-hyperplane bits of each row."""
    out = []
    for k in range(math.ceil(bits / SKETCH)):
        flips = np.where(X.mix(np.arange(k * SKETCH + 1, (k + 1) * SKETCH + 1, dtype=np.uint64)) >> np.uint64(63), 1, -1).astype(np.float32)
        x, half = sketches.astype(np.float32) * flips, 1
        while half < SKETCH:
            y = x.reshape(len(x), -1, 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), SKETCH)
            half *= 2
        out.append(x >= 0)
    return np.concatenate(out, axis=1)[:, :bits]


def most_shingles(similarity: float) -> int:
    """The largest set that can have the similarity to one of fewer than FEW shingles."""
    return math.floor((FEW - 1) / similarity + 1e-6)


def prints(docs: DataFrame, shingle: int, bits: int, bands: int, similarity: float) -> DataFrame:
    """Of each row doc_id, two hashes of the text (t0, t1), the fingerprint of operator 8 (fp), the 128-bit hash of its shingle set (k0, k1), its CHECK bits (c0, c1) and its bands' bits (null for fewer than FEW shingles), and the shingles themselves where they are few."""
    most = most_shingles(similarity)

    def each(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts, rows, coded, few = batch.column("text"), np.zeros((batch.num_rows, 5), np.uint64), [None] * batch.num_rows, []
            for at in range(0, batch.num_rows, STEP):
                held, wide = [], []
                for i, text in enumerate(texts[at : at + STEP]):
                    hashes = shingle_set(text.as_py(), shingle)
                    key = xxhash.xxh3_128_intdigest(hashes.tobytes())
                    rows[at + i, 0], rows[at + i, 1] = key >> 64, key & (2**64 - 1)
                    few.append(hashes.view(np.int64) if len(hashes) <= most else None)
                    rows[at + i, 4] = fingerprint(text.as_py())
                    if len(hashes) >= FEW:
                        held.append(sketch(hashes))
                        wide.append(at + i)
                if held:
                    bit = signs(np.stack(held), CHECK + bits * bands)
                    rows[wide, 2:4] = np.packbits(bit[:, :CHECK], axis=1).view("<u8")
                    for i, v in zip(wide, np.packbits(bit[:, CHECK:], axis=1)):
                        coded[i] = v.tobytes()
            signed = rows.view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in UNIT), *(pa.array(signed[:, k].copy()) for k in range(5)), pa.array(coded, pa.binary()), pa.array(few, pa.list_(pa.int64()))], names=[*UNIT, "k0", "k1", "c0", "c1", "fp", "bands", "few"])

    return docs.select(*UNIT, "text").mapInArrow(each, "doc_id long, t0 long, t1 long, k0 long, k1 long, c0 long, c1 long, fp long, bands binary, few array<long>")


def rare_groups(classes: DataFrame, similarity: float) -> DataFrame:
    """cid and comp: groups, of two classes at least, in which all classes of few shingles meet those that can have the similarity, one in several groups.

    A set of n shingles shares similarity * n at least with any partner.  In any one order of all shingles, so the
    first n - ceil(similarity * n) + 1 of both have one in common; the rarest come first.  Shingles of a single class
    are counted and not looked up.  Sizes that allow the similarity are in the same step of powers or the next.
    """
    shingles = classes.where("few IS NOT NULL").select("cid", F.size("few").alias("n"), F.explode("few").alias("h"))
    counts = shingles.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = shingles.join(counts, "h").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1 - (F.col("n") - F.size("hs"))
    step = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity) + 1e-6)
    taken = shared.where(first > 0).select("cid", step.alias("step"), F.explode(F.slice("hs", F.lit(1), first.cast("int"))).alias("at"))
    groups = written(taken.select("cid", F.explode(F.array(F.xxhash64("at.h", "step"), F.xxhash64("at.h", F.col("step") + 1))).alias("comp")))
    return groups.join(groups.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1"), "comp").select("cid", "comp")


def loose_links(classes: DataFrame, n: int, bits: int, bands: int, some: range) -> DataFrame:
    """Links (a, b) between groups that join up all classes (cid, group, c0, c1, bands) that meet in one of some bands and are near."""
    tasks = max(parts(classes.sparkSession), math.ceil(n * len(some) / TASK_ENTRIES))

    def entries(batches):
        import pyarrow as pa

        for batch in batches:
            m = batch.num_rows
            packed = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint8).reshape(m, -1)
            wide = np.zeros((m, len(some), 64), np.uint8)
            wide[:, :, :bits] = np.unpackbits(packed, axis=1, count=bits * bands).reshape(m, bands, bits)[:, some.start : some.stop]
            values = np.packbits(wide, axis=2, bitorder="little").view("<u8")[:, :, 0]
            out = np.empty((m, len(some), 4), np.uint64)
            out[:, :, 0] = X.mix(values + np.arange(some.start, some.stop, dtype=np.uint64) * np.uint64(X.ODD))  # a one-to-one image of the value, for each band
            for k, c in enumerate(("group", "c0", "c1"), 1):
                out[:, :, k] = batch.column(c).to_numpy().view(np.uint64)[:, None]
            out = out.reshape(-1, 4)
            to = (out[:, 0] % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(tasks + 1))
            full = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([out[order[ends[i] : ends[i + 1]]].tobytes() for i in full], pa.binary())], names=["task", "rows"])

    def walk(got):
        import pyarrow as pa

        rows = np.concatenate([np.frombuffer(r, np.uint64).reshape(-1, 4) for r in got["rows"].to_pylist()])
        groups, who = np.unique(rows[:, 1].view(np.int64), return_inverse=True)
        order = np.lexsort((who, rows[:, 0]))
        rows, who = rows[order], who[order]
        stars, check, n = Stars(len(groups)), rows[:, 2:].copy(), np.arange(len(rows))
        ends = np.searchsorted(rows[:, 0], rows[:, 0], side="right")  # of those that meet
        cut = np.concatenate([(rows[1:, 0] != rows[:-1, 0]) | (who[1:] != who[:-1]), np.ones(min(1, len(rows)), bool)])
        others = np.flatnonzero(cut)[np.cumsum(cut) - cut] + 1  # where those of other groups begin
        first = np.searchsorted(rows[:, 0], rows[:, 0], side="left")
        large = ends - first > MANY
        later = np.where(large, 0, ends - others)
        for s in chunks(later, 1 << 18):
            left = np.repeat(n[s], later[s])
            right = others[left] + np.arange(len(left)) - np.repeat(np.cumsum(later[s]) - later[s], later[s])
            near = np.bitwise_count(check[left] ^ check[right]).sum(axis=1) <= LOOSE
            stars.link(who[left[near]], who[right[near]])
        for at in np.flatnonzero(large & (first == n)).tolist():
            sweep(who[at : ends[at]], check[at : ends[at]], stars)
        root = stars.roots(np.arange(len(groups)))
        moved = np.flatnonzero(root != np.arange(len(groups)))
        return pa.table({"a": pa.array(groups[moved]), "b": pa.array(groups[root[moved]])})

    return classes.select("group", "c0", "c1", "bands").mapInArrow(entries, "task int, rows binary").repartition(tasks, "task").groupBy("task").applyInArrow(walk, "a long, b long")


def sweep(who: np.ndarray, check: np.ndarray, stars: Stars) -> None:
    """Links all near rows and those of one group: each is compared only with those that nothing has reached yet."""
    left, reached = np.arange(len(who)), np.zeros(0, np.int64)
    while len(left):
        if not len(reached):
            reached, left = left[:1], left[1:]
        i, reached = reached[-1], reached[:-1]
        near = (who[left] == who[i]) | (np.bitwise_count(check[left] ^ check[i]).sum(axis=1) <= LOOSE)
        if near.any():
            found, left = left[near], left[~near]
            stars.link(who[found], np.full(len(found), who[i]))
            reached = np.concatenate([reached, found])


def loose_groups(classes: DataFrame, n: int, bits: int, bands: int) -> DataFrame:
    """cid and comp: the loose groups of classes (cid, c0, c1, bands), each of two at least."""
    first = written(loose_links(classes.withColumn("group", F.col("cid")), n, bits, bands, range(min(FIRST, bands))))
    if bands > FIRST:
        known = written(components(first))
        linked, single = sifted(classes, [F.col("cid")], known, ["node"])
        named = linked.join(known, F.col("cid") == F.col("node"), "left").withColumn("group", F.coalesce("component", "cid")).drop("node", "component")
        more = loose_links(named.unionByName(single.withColumn("group", F.col("cid"))), n, bits, bands, range(FIRST, bands))
        first = written(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return components(first).select(F.col("node").alias("cid"), F.col("component").alias("comp"))


def chunks(sizes: np.ndarray, most: int) -> list[slice]:
    """Slices of about `most` each, by running size."""
    if not len(sizes) or not sizes.any():
        return []
    ends = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()) + most, most), side="left") + 1).clip(max=len(sizes))
    return [slice(lo, hi) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()) if hi > lo]


def shingle_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """cid and hashes, the shingle set, of members (cid, each once, and a document of the class).  Texts that are not asked for are not shuffled."""

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            hashes = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(hashes, pa.binary())], names=["cid", "hashes"])

    members = written(members.select("cid", *UNIT))
    likely, _ = sifted(docs, [F.col(c) for c in UNIT], members, UNIT)
    return likely.dropDuplicates(UNIT).join(members, UNIT).select("cid", "text").mapInArrow(sets, "cid long, hashes binary")


def piece(pieces: str):
    return F.pmod(F.xxhash64("cid"), pieces).cast("int")


def upto(n):
    """0 to n - 1, none for n = 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)


def spot(p, q):
    return F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))


def each_two(at, pieces):
    """Where a member of a piece goes so that it meets every piece's members."""
    return F.transform(upto(pieces), lambda i: spot(F.least(at, i), F.greatest(at, i)))


def exact_links(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join up all members (cid, comp, spots) which meet in a spot (p, q) of like comp and have the similarity."""
    met = sets.join(members, "cid").select("comp", "cid", "hashes", F.explode("spots").alias("s")).select("comp", "cid", "hashes", "s.p", "s.q")

    def compare(batches):
        import pyarrow as pa

        batches = list(batches)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        got = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("comp", "p", "q", "cid")]) if batches else None
        if got is not None and got.num_rows:
            key = np.stack([got[c].to_numpy() for c in ("comp", "p", "q")], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            cid, hashes = got["cid"].to_numpy(), got["hashes"]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if hi - lo > 1:
                    i, j = similar([np.frombuffer(hashes[k].as_py(), np.uint64) for k in range(lo, hi)], similarity)
                    a.append(cid[lo:hi][i])
                    b.append(cid[lo:hi][j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return met.repartition(parts(sets.sparkSession) * 2, "comp", "p", "q").mapInArrow(compare, "a long, b long")


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star links among sets that join up all pairs with the similarity."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_id = np.argsort(ids, kind="stable")
    posts, begins = owner[by_id], np.searchsorted(ids[by_id], np.arange(ids.max() + 2 if len(ids) else 1))
    at, stars = np.concatenate([[0], np.cumsum(sizes)]), Stars(len(sets))
    for i in range(len(sets)):
        mine = ids[at[i] : at[i + 1]]
        lo, n = begins[mine], begins[mine + 1] - begins[mine]
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        common = np.bincount(posts[flat], minlength=len(sets))
        alike = np.flatnonzero(common >= similarity * (sizes + sizes[i] - common) - 1e-9)
        alike = alike[(alike > i) & (sizes[alike] + sizes[i] > 0)]
        if len(alike):
            stars.link(np.full(len(alike), i), alike)
    root = stars.roots(np.arange(len(sets)))
    moved = np.flatnonzero(root != np.arange(len(sets)))
    return moved, root[moved]


def tight_links(docs: DataFrame, classes: DataFrame, loose: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) that join up all classes (cid, comp; a cid can be in several) of like comp with the similarity, in the three rounds of step 3."""

    def joined(links: DataFrame, of: DataFrame) -> DataFrame:
        """of with group, the component that the links give."""
        found = components(links).select(F.col("node").alias("cid"), F.col("component").alias("group"))
        return written(of.join(found, "cid", "left").withColumn("group", F.coalesce("group", "cid")))

    sets = written(shingle_sets(docs, classes.select("cid", *UNIT).join(loose.select("cid").distinct(), "cid"), shingle))
    sizes = loose.groupBy("comp").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    members = written(loose.join(sizes, "comp"))
    inside = written(exact_links(sets, members.withColumn("spots", F.array(spot(piece("pieces"), piece("pieces")))).select("cid", "comp", "spots"), similarity))
    large = members.where("pieces > 1").select("cid", "comp")
    if large.isEmpty():
        return inside
    firsts = joined(inside, large).groupBy("comp", "group").agg(F.min("cid").alias("cid")).select("cid", "comp")
    counts = firsts.groupBy("comp").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    between = written(exact_links(sets, firsts.join(counts, "comp").withColumn("spots", each_two(piece("pieces"), F.col("pieces"))).select("cid", "comp", "spots"), similarity))
    both = inside.unionByName(between)
    groups = joined(both, large)
    ranked = groups.groupBy("comp", "group").agg(F.count("*").alias("n"))
    main = ranked.groupBy("comp").agg(F.max(F.struct("n", "group")).alias("main"), F.sum("n").alias("all"))
    open_ = main.where("all > main.n").select("comp", F.col("main.group").alias("main"), F.ceil(F.col("main.n") / PIECE).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("main.n")) / PIECE).cast("int").alias("rests"))
    left = groups.join(open_, "comp").withColumn("rest", F.col("group") != F.col("main"))
    left = left.withColumn("at", F.when(F.col("rest"), piece("rests")).otherwise(piece("mains")))
    with_main = F.transform(upto(F.col("mains")), lambda k: spot(F.col("at"), F.col("rests") + k))
    with_rest = F.transform(upto(F.col("rests")), lambda i: spot(i, F.col("rests") + F.col("at")))
    spots = F.when(F.col("rest"), F.concat(each_two(F.col("at"), F.col("rests")), with_main)).otherwise(with_rest)
    return both.unionByName(exact_links(sets, left.select("cid", "comp", spots.alias("spots")), similarity))


def units(docs: DataFrame) -> DataFrame:
    """docs (those with a doc_id) with a number for each different text."""
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(0), text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1"))


def compared(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of units: their prints, the classes of equal shingle sets (cid, k0, k1, n) and links (a, b) that join up all classes with the similarity."""
    n = docs.count()
    bits, bands = plan(n, similarity, MISS)
    found = written(prints(docs, shingle, bits, bands, similarity))
    first = F.min(F.struct(*UNIT, "c0", "c1", "bands", "few")).alias("first")
    classes = found.groupBy("k0", "k1").agg(first, F.count("*").alias("n")).select("k0", "k1", "n", "first.*")
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    loose = loose_groups(classes.where("bands IS NOT NULL").select("cid", "c0", "c1", "bands"), n, bits, bands)
    loose = loose.unionByName(rare_groups(classes, similarity))
    return found, classes.select("cid", "k0", "k1", "n"), written(tight_links(docs, classes, written(loose), similarity, shingle))


def near_components(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by links, for each row with a doc_id."""
    found, classes, links = compared(units(docs), similarity, shingle)
    placed = classes.join(components(links), F.col("cid") == F.col("node"), "left").select("k0", "k1", "n", F.coalesce("component", "cid").alias("component"))
    known = spread_join(found.select("doc_id", "k0", "k1"), written(placed), ["k0", "k1"], "n").select("doc_id", "component")
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    return spread_join(known, least, ["component"], "n").select("doc_id", "component_id")


def remove_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay: of each group one document with the smallest doc_id.  Groups join up documents with the similarity and those that operator 8 links by its own fingerprints."""
    held = scratch.mark()
    found, classes, tight = compared(units(docs), similarity, shingle)
    # fingerprints are nodes beside the classes: numbers below zero
    both = written(found.groupBy("k0", "k1", "fp").agg(F.count("*").alias("n")).join(classes.select("cid", "k0", "k1"), ["k0", "k1"]).select("cid", "fp"))
    fps = written(both.groupBy("fp").agg(F.count("*").alias("m")).withColumn("fid", -F.monotonically_increasing_id() - 1))
    alike = written(near_links(fps.select("fp"), DISTANCE))
    ends = alike.select(F.col("a").alias("fp")).unionByName(alike.select(F.col("b").alias("fp"))).distinct()
    used = written(fps.join(ends.withColumn("end", F.lit(True)), "fp", "left").where("m > 1 OR end").select("fp", "fid", "m"))
    at = used.select("fp", "fid")
    by_print = alike.join(at.toDF("a", "x"), "a").join(at.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = spread_join(both, used, ["fp"], "m").select(F.col("cid").alias("a"), F.col("fid").alias("b"))
    joined = components(written(tight.select("a", "b").unionByName(by_print).unionByName(members)))
    placed = classes.join(joined, F.col("cid") == F.col("node"), "left").where("component IS NOT NULL OR n > 1")
    placed = written(placed.select("k0", "k1", "n", F.coalesce("component", "cid").alias("component")))
    grouped = written(spread_join(found.select(*UNIT, "k0", "k1"), placed, ["k0", "k1"], "n").select(*UNIT, "component"))
    stays = grouped.groupBy("component").agg(F.min(F.struct(*UNIT)).alias("stays"), F.count("*").alias("n"))
    gone = spread_join(grouped, stays, ["component"], "n").where(F.struct(*UNIT) != F.col("stays")).select(*UNIT).distinct()
    twice = grouped.groupBy(*UNIT).agg(F.count("*").alias("n")).where("n > 1").select(F.struct(*UNIT).alias("_twice"))
    gone, twice = written(gone), written(twice)
    scratch.release(docs.sparkSession, since=held, but=2)  # what follows reads these two and docs
    text, own = F.coalesce("text", F.lit("")), "_unit" + "_" * max(map(len, docs.columns))  # no column of docs
    marked = docs.withColumn(own, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(0), text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1")))
    likely, sure = sifted(marked, [F.col(own)[c] for c in UNIT], gone, UNIT)
    left = sure.unionByName(likely.join(gone.select(F.struct(*UNIT).alias("_gone")), F.col(own) == F.col("_gone"), "left_anti"))
    if not twice.isEmpty():
        again, once = sifted(left, [F.col(own)[c] for c in UNIT], twice.select("_twice.*"), UNIT)
        one = again.join(twice, F.col(own) == F.col("_twice"), "left_semi").dropDuplicates([own])
        left = once.unionByName(again.join(twice, F.col(own) == F.col("_twice"), "left_anti")).unionByName(one)
    return left.select(*docs.columns)
