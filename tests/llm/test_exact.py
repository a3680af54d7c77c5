"""The operators with exact contracts against plain versions, on odd documents and on none."""

import random

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import components, ctw, decontam, hilbert, mixing, simhash, substring, suffix, tokens, vectors

ROWS = B.odd_documents()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("window", [21, 35])
def test_op1(spark, window):
    got = substring.remove_repeats(B.frame(spark, ROWS), window, block_bytes=4000)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(B.substring(ROWS, window), key=str)
    assert sum(r["n_removed"] for r in got.collect()) > 300
    with pytest.raises(ValueError):
        substring.remove_repeats(B.frame(spark, ROWS), 5)


def test_op2(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(5)
    alphabet = "abcXYZ .,'’-–_019\t\n\r\x0b\x00éÉïß€漢字🙂ı́ſ<|>/"
    rows = ROWS + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(600, "it's we'll THEY'VE don't 'S"), (601, "<|endoftext|> a <|startoftext|>b"), (602, "Ａ ﬁ ² ½ İstanbul"), (603, "word " * 3000)]
    library = tokens.load(path)
    expected = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for k, t in rows]
    got = tokens.count_tokens(B.frame(spark, rows), path)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=str)


def vector_rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = [b + rng.standard_normal(16) * s for b in base[:20] for s in (0.05, 0.2, 0.3)]
    full = [[float(x) for x in v] for v in [*base, *near, *base[:5], 3 * base[7]]]
    full += [None, [], [0.0] * 16, [None, *full[0][1:]], [float("nan"), *full[0][1:]], [float("inf"), *full[0][1:]], full[0][:8], [x * 1e30 for x in full[0]]]
    rows = [(i, v) for i, v in enumerate(full)]
    return rows + [(3, full[3]), (None, full[4])]


def test_op3(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, key string, band int").repartition(3)

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v) / max(map(abs, v))
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v in rows]
    linked = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.95
    ids = B.smallest([k for k, _ in rows], B.roots(len(rows), linked))
    expected = [(k, sum(linked(max(i, j), min(i, j)) for j in range(len(rows)) if j != i), c, None if k is None else k == c) for i, ((k, _), c) in enumerate(zip(rows, ids))]
    got = vectors.near_vectors(df)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == sorted(expected, key=str)


def test_op6(spark):
    rows = [(k, t) for k, t in ROWS if len(t or "") < 700]
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    is_held = [k is not None and k % 3 == 0 for k, _ in rows]
    got = ctw.score(B.frame(spark, rows), held, block_bytes=2000)
    train = [t for (_, t), h in zip(rows, is_held) if not h]
    logs = B.context_trees(train, [t for _, t in rows], ctw.DEPTH)
    counts = B.Counter(w for t in train for w in [*B.WORD.findall((t or "").encode().lower()), None])
    total = sum(counts.values())
    expected = []
    for (k, t), h, log in zip(rows, is_held, logs):
        words = [*B.WORD.findall((t or "").encode().lower()), None]
        base = sum(B.math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)
        expected.append((k, h, len(words), sum(counts[w] > 0 for w in words), total, round(base, 5), round(log, 3)))
    found = got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5), F.round("score", 3)).collect()
    for mine, theirs in zip(sorted(map(tuple, found), key=str), sorted(expected, key=str)):
        assert mine[:5] == theirs[:5] and mine[5:] == pytest.approx(theirs[5:], abs=2e-3)
    untaught = ctw.score(B.frame(spark, [(1, "xyz")]), F.lit(True)).first()
    assert untaught["score"] == pytest.approx(8 * 4 * B.math.log10(0.5), abs=1e-3) and untaught["train_tokens"] == 0


@pytest.mark.parametrize("same", [False, True])
def test_op6_more_rows_of_a_key_than_two_bytes_count(spark, same):
    rows = spark.range(70_000).select("id", F.when(F.lit(same), "one").otherwise(F.concat(F.lit("t"), F.col("id") % 501)).alias("text"))

    def scored(key):
        docs = rows.select(key.cast("long").alias("doc_id"), "text")
        return {tuple(r) for r in ctw.score(docs, F.lit(False)).groupBy(F.round("score", 3).alias("s"), F.round("base_score", 5).alias("b"), "n_bytes", "n_tokens").agg(F.count("*").alias("n")).collect()}

    assert scored(F.lit(None)) == scored(F.col("id"))


def test_op6_blocks_of_many_rows():
    import pyarrow as pa

    texts = [f"t{i % 501}" for i in range(70_000)]
    block = ctw.Block(pa.table({"doc_id": pa.nulls(70_000, pa.int64()), "text": texts, "held_out": [False] * 70_000, "block": pa.array([0] * 70_000, pa.int32())}))
    assert np.bincount(block.row).tolist() == [len(t) + 1 for t in texts] and not (block.grams >> np.uint64(48)).any()


def test_op8(spark):
    prints = [B.fingerprint(t, 4) for _, t in ROWS]
    for distance in (4, 9):
        of = B.roots(len(ROWS), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= distance)
        expected = [(k, f"{p:016x}", c) for (k, _), p, c in zip(ROWS, prints, B.smallest([k for k, _ in ROWS], of))]
        got = simhash.near_components(B.frame(spark, ROWS), distance)
        assert rows_of(got, "doc_id", "fingerprint", "component_id") == sorted(expected, key=str)


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [int(c) ^ sum(1 << b for b in set(rng.integers(0, 64, rng.integers(0, 6)).tolist())) for c in centres for _ in range(6)]
    values = np.unique(np.array(flips, np.uint64))
    for head in (1, 4, 12):
        found = set()
        simhash.pairs(values, head, 4, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
        at, to = np.triu_indices(len(values), 1)
        top = values >> np.uint64(64 - head)
        near = (np.bitwise_count(values[at] ^ values[to]) <= 4) & (top[at] == top[to])
        assert {tuple(sorted(p)) for p in found} == set(zip(at[near].tolist(), to[near].tolist())) and near.any()


def test_op9_many_automata(spark):
    docs, bench = B.frame(spark, [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 and a short item")]), spark.createDataFrame(BENCHMARK, "item_id long, text string")
    one, many = (decontam.find_benchmarks(docs, bench, pattern_bytes=n).first() for n in (1 << 20, 1))
    assert one == many and len(one["spans"]) == 2
    assert len(decontam.automata(docs, bench, 8, 1)) > 5 and len(decontam.automata(docs, bench, 8, 1 << 20)) == 1


BENCHMARK = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (2, "W2, w3; w4 w5 w6 w7 w8 w9"), (3, "short item"), (4, None), (5, " .. "), (None, "a b c"), (10, "same same same same same same same same"), (6, "short item"), (7, "ünï çödé")]


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 0])
def test_op9(spark, pattern_bytes):
    docs = ROWS + [(200, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 y"), (201, "A short; ITEM w2 w3"), (202, "ÜNÏ çödé short item short item"), (203, "w2 w3 w4 w5 w6 w7 w8")]
    bench = spark.createDataFrame([(*r, "x") for r in BENCHMARK], "item_id long, text string, doc_id string")
    got = decontam.find_benchmarks(B.frame(spark, docs), bench, pattern_bytes=pattern_bytes)
    expected = B.items(docs, BENCHMARK, 8)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == sorted(expected, key=str)
    clean = decontam.remove_contaminated(B.frame(spark, docs), bench, 1, pattern_bytes=pattern_bytes)
    assert sorted((r["doc_id"] or -1 for r in clean.collect())) == sorted(e[0] or -1 for e in expected if not e[3])
    assert decontam.find_benchmarks(B.frame(spark, docs), bench.limit(0), pattern_bytes=pattern_bytes).where("n_items > 0").isEmpty()


def test_op9_spans(spark):
    original = "Äh: W1, w2-w3 w4 w5 w6 w7 (w8)! then Short\nitem."
    row = decontam.find_benchmarks(B.frame(spark, [(1, original)]), spark.createDataFrame(BENCHMARK, "item_id long, text string")).first()
    raw = original.encode()
    assert [raw[s["start"] : s["end"]].decode() for s in row["spans"]] == ["W1, w2-w3 w4 w5 w6 w7 (w8", "Short\nitem"]
    assert row["item_ids"] == ["1", "3", "6"]


def test_op10(spark):
    got = suffix.remove_repeats(B.frame(spark, ROWS), block_bytes=4000)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(B.suffix(ROWS, 100), key=str)
    kept = {r["doc_id"]: r["kept"] for r in got.where("doc_id IN (5, 6)").collect()}
    assert kept[5].decode() == ROWS[7][1] and kept[6] == b""


def test_ties_with_earlier():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 3, 260).astype(np.uint8)
    pieces = [base, rng.integers(0, 256, 200).astype(np.uint8), np.zeros(180, np.uint8), base[30:170]]
    for cut in range(60, 100, 4):  # one head with many ends
        pieces.append(np.concatenate([base[:cut], rng.integers(4, 9, 110 - cut).astype(np.uint8)]))
    pieces += pieces[-3:]
    data, starts = np.concatenate(pieces), []
    for i, p in enumerate(pieces):
        at = sum(map(len, pieces[:i]))
        starts += range(at, at + len(p) - suffix.DEPTH + 1)
    seen, expected = set(), []
    for s in starts:
        expected.append(bytes(data[s : s + suffix.DEPTH]) in seen)
        seen.add(bytes(data[s : s + suffix.DEPTH]))
    assert suffix.ties_with_earlier(data, np.array(starts)).tolist() == expected and 100 < sum(expected) < len(starts)


def test_op10_rows_of_one_id(spark):
    rng = random.Random(12)
    passage = B.text(rng, 40)
    rows = [(None if i % 2 else 7, f"{B.text(rng, 20)} {passage} {B.text(rng, 20)}" if i % 3 else "the same text " * 20) for i in range(120)]
    got = suffix.remove_repeats(B.frame(spark, rows), block_bytes=3000)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(B.suffix(rows, 100), key=str)


def test_op1_rows_of_one_id(spark):
    rng = random.Random(13)
    passage = B.text(rng, 40)
    rows = [(None if i % 2 else 7, f"{B.text(rng, 20)} {passage} {B.text(rng, 20)}" if i % 3 else "the same text " * 20) for i in range(120)]
    got = substring.remove_repeats(B.frame(spark, rows), 35, block_bytes=3000)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(B.substring(rows, 35), key=str)


def test_cover_is_a_difference_cover():
    for period, cover in ((substring.PERIOD, substring.COVER), (suffix.PERIOD, suffix.COVER)):
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_op7(spark):
    docs = B.frame(spark, [(*r, "en" if i % 3 else None, f"s{i % 4}") for i, r in enumerate(ROWS)])
    rows = hilbert.shard(docs, shards=5, keep=("doc_id", "group", "lang")).collect()
    counts = B.Counter(r["shard"] for r in rows)
    assert len(rows) == len(ROWS) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    order = [r["hilbert"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    import zlib

    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(k), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in ROWS)
    assert hilbert.shard(docs.limit(0)).count() == 0
    assert {r["group"] for r in rows} == {"11"}


def test_hilbert_curve_is_continuous():
    axes = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    points = np.stack([a.ravel() for a in axes], axis=1)
    index = hilbert.hilbert_index([points[:, i] for i in range(3)], 3)
    assert sorted(index.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_op4(spark, duck):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, None if i % 41 == 0 else B.text(rng, rng.randrange(40)), rng.choice(["en", "de", "xx", None]), None if i % 37 == 0 else rng.choice(["s0", "s0", "s0", "s1", "s2", "s3"])) for i in range(400)]
    rows += rows[:20]
    docs = B.frame(spark, rows)
    import pyarrow as pa

    duck.register("odd", pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))}))
    relation = duck.sql(mixing.SQL.replace("FROM documents", "FROM odd"))
    from conftest import same

    same(mixing.mix(docs), relation)
    per = mixing.mix(docs).groupBy("domain", "lang", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("used"), F.max("leaf_budget").alias("budget")).collect()
    assert all(r["used"] <= r["budget"] for r in per)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(docs).agg(F.sum("n_copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, lang_weights={"en": 0})


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)]
    found = mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 0.5, 1, {}, {}, {}).collect()
    assert {r["source"]: r["budget"] for r in found} == {"a": 10, "b": 492, "c": 502}


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)] + [(2000, i) for i in range(2001, 2200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


EMPTY = {
    "op1": lambda d: substring.remove_repeats(d), "op6": lambda d: ctw.score(d, F.lit(False)), "op8": lambda d: simhash.near_components(d), "op10": lambda d: suffix.remove_repeats(d),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, name):
    assert EMPTY[name](B.frame(spark, ROWS).limit(0)).count() == 0


def test_op3_vectors_of_one_id(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(3, a.tolist()), (3, b.tolist()), (7, (a + 0.01 * b).tolist()), (-5, (2 * b).tolist()), (None, b.tolist())]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert rows_of(got, "vec_id", "n_links", "component_id") == sorted([(3, 1, 3), (3, 2, -5), (7, 1, 3), (-5, 2, -5), (None, 2, -5)], key=str)


def test_op3_large_groups_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 7)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3, 24))
    held = np.concatenate([base[rng.integers(0, 3, 90)] + 0.12 * rng.standard_normal((90, 24)), rng.standard_normal((60, 24))])
    unit = held / np.linalg.norm(held, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    of = B.roots(len(held), lambda i, j: near[i, j])
    expected = [(i, int(near[i].sum()) - 1, c) for i, c in enumerate(B.smallest(list(range(len(held))), of))]
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "vec_id long, embedding array<double>"))
    assert rows_of(got, "vec_id", "n_links", "component_id") == sorted(expected, key=str) and near.sum() > 1000


def test_op3_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
