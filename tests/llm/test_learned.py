"""The quality classifier, the near-copy stage and the pipeline."""

import itertools
import random

import brute as B
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from turnstone.llm import near, quality, registry, simhash
from turnstone.llm.common import sifted, table, written
from turnstone.sources import scratch

ROWS = B.odd_documents()


def test_op5_held_out(spark):
    scored = quality.op5_quality(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1].score.to_numpy(), scored[scored.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (good >= 0.3).mean() > 0.95 and (bad < 0.3).mean() > 0.75


def test_op5_odd_documents(spark):
    docs = B.frame(spark, ROWS)
    labels = spark.createDataFrame([(5, 1, 0), (11, 0, 0), (20, 1, 1), (21, 0, None), (999, 1, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = docs.select("doc_id", quality.score_column(model)(F.col("text")).alias("score")).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {round(r["score"], 6) for r in got if r["doc_id"] in (1, 2, 3)} == {round(model.prior, 6)}
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns
    for some in (labels.limit(0), labels.where("quality = 1")):
        flat = quality.train(docs, some)
        scores = {r["score"] for r in docs.select(quality.score_column(flat)(F.col("text")).alias("score")).collect()}
        assert len({round(s, 6) for s in scores}) == 1 and 0 <= scores.pop() <= 1
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_marginals_by_enumeration():
    odds, tie = np.array([0.3, -1.2, 2.0, 0.1, -0.4]), 0.7
    bounds = np.array([0, 3, 3, 5])
    got = quality.marginals(odds, quality.walk(bounds), tie)
    for a, b in zip(bounds[:-1], bounds[1:]):
        total, good = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            y = np.array([code >> i & 1 for i in range(b - a)])
            weight = np.exp((y * odds[a:b]).sum() + tie * (y[1:] == y[:-1]).sum())
            total, good = total + weight, good + weight * y
        if b > a:
            assert got[a:b] == pytest.approx(np.log(good / (total - good)))


def survivors(rows):
    """Smallest doc_ids of the groups of near copies, by all pairs."""
    prints, sets = [B.fingerprint(t, 4) for _, t in rows], [B.shingles(t, 5) for _, t in rows]
    of = B.roots(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or B.jaccard(sets[i], sets[j]) >= 0.8)
    return sorted(set(B.smallest([k for k, _ in rows], of)))


def survivors_of_rows(rows):
    """The doc_ids of the rows that stay, where ids repeat: one row of each group, one with the smallest id."""
    prints, sets = [B.fingerprint(t, 4) for _, t in rows], [B.shingles(t, 5) for _, t in rows]
    of = B.roots(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or B.jaccard(sets[i], sets[j]) >= 0.8)
    return sorted(min(k for (k, _), r in zip(rows, of) if r == root) for root in set(of))


def test_near_copies_by_all_pairs(spark):
    rows = [r for r in ROWS if r[0] is not None]
    docs = B.frame(spark, ROWS)
    kept = near.remove_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == survivors_of_rows(rows)
    assert kept.where("doc_id IS NULL").count() == 2
    assert near.remove_near_copies(docs.limit(0)).count() == 0


def test_short_near_copies_by_all_pairs(spark):
    rng = random.Random(31)
    rows = []
    for _ in range(700):  # at 0.8 or just over it: 4 and 5, 5 and 6, 8 of 9 and 9, 64 and 80 shingles
        for length, cut, more in ((8, 0, 1), (9, 0, 1), (13, 1, 1)) if len(rows) < 3600 else ((68, 0, 16), (67, 0, 15)):
            words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[cut:] + [f"v{rng.randrange(10**6)}" for _ in range(more)]))]
    rows += [(len(rows) + i, f"the same five words here {i} w{rng.randrange(9)}") for i in range(900)]  # one shingle that many share
    sets, held = {k: frozenset(near.shingle_set(t, near.SHINGLE).tolist()) for k, t in rows}, {}
    for k, s in sets.items():
        for h in s:
            held.setdefault(h, []).append(k)
    stars = simhash.Stars(len(rows))
    for at in held.values():
        for i, j in itertools.combinations(at, 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                stars.link(np.array([i]), np.array([j]))
    expected = stars.roots(np.arange(len(rows)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(B.frame(spark, rows)).collect()}
    assert len(got) == len(rows) and (expected != np.arange(len(rows))).sum() > 1000
    assert [k for k, _ in rows if got[k] != expected[k]] == []


def test_near_copies_of_the_table(spark):
    docs = table(spark, DATA, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in near.remove_near_copies(docs).collect()) == survivors(rows)


def test_large_groups_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(near, "PIECE", 7)
    rng = B.random.Random(8)
    base = B.text(rng, 120).split()
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(w)))
    for i in range(60):  # chains: neighbours are alike, ends are not
        w = list(base)
        for k in range(i):
            w[2 * k % 120] = f"step{k}"
        rows.append((200 + i, " ".join(w)))
    rows += [(100 + i, B.text(rng, 60)) for i in range(10)]
    assert sorted(r["doc_id"] for r in near.remove_near_copies(B.frame(spark, rows)).collect()) == survivors(rows)


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    columns, held = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = table(spark, DATA, "labels")
    model = quality.train(docs, labels)
    good = {r["doc_id"] for r in docs.where(quality.score_column(model)(F.col("text")) >= quality.THRESHOLD).collect()}
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    first = stages[names[0]](spark, docs, DATA)
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == good
    second = stages[names[1]](spark, first, DATA)
    singles = survivors([(k, held[k]) for k in sorted(good)])
    assert second.columns == columns and sorted(r["doc_id"] for r in second.collect()) == singles
    third = stages[names[2]](spark, second, DATA)
    bench = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    clean = sorted(r[0] for r in B.items([(k, held[k]) for k in singles], bench, 8) if r[3] == 0)
    assert third.columns == columns and sorted(r["doc_id"] for r in third.collect()) == clean
    final = corpus_pipeline.run(spark, DATA).collect()
    ids = [r["doc_id"] for r in final]
    assert set(ids) <= set(clean) and len(ids) == len(set(ids)) and len(ids) > 0.5 * len(clean)
    assert all(r["text"] == held[r["doc_id"]] for r in final)


def test_registry():
    queries = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries) == list(range(1, 11))
    assert all(isinstance(v, str) for v in registry.oracle_sql().values()) and set(registry.oracle_sql()) <= set(queries)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_sql(spark, duck, name):
    from conftest import same

    same(registry.queries()[name](spark, DATA), duck.sql(registry.oracle_sql()[name]))


def test_near_copies_of_repeated_ids(spark):
    rng = random.Random(77)
    rows = []
    for i in range(12):  # the original shares its id with an unrelated text
        base = B.text(rng, 120).split()
        other = list(base)
        other[60] = "changed"
        rows += [(i, B.text(rng, 100, 10**6)), (i, " ".join(base)), (100 + i, " ".join(other))]
    rows += [(500, "one unrelated text of some words"), (500, "and quite another one with other words"), (500, "and quite another one with other words")]
    kept = sorted((r["doc_id"], r["text"]) for r in near.remove_near_copies(B.frame(spark, rows)).collect())
    assert kept == sorted({r for r in rows if r[0] < 100 or r[0] == 500})


def test_rows_without_partner_are_not_shuffled(spark):
    rng = random.Random(5)
    rows = [(i, B.text(rng, 90, 10**6)) for i in range(200)]
    rows += [(1000 + i, t + " more") for i, (_, t) in enumerate(rows[:40])]
    docs, keys = B.frame(spark, rows), B.frame(spark, rows[150:190]).select("doc_id")
    likely, sure = sifted(docs, [F.col("doc_id")], keys, ["doc_id"])
    met, left = ({r["doc_id"] for r in x.collect()} for x in (likely, sure))
    assert set(range(150, 190)) <= met and met.isdisjoint(left) and met | left == {k for k, _ in rows} and len(met) < 60
    before, threshold = scratch.mark(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near.remove_near_copies(docs)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.startswith("Union") and "SortMergeJoin" not in plan.split("\n+- ")[0]  # what surely stays
    assert scratch.mark() - before <= 4  # tables on disk: what goes, what is there twice, and their bitmaps


def test_shuffle_files_go_when_a_table_is_written(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in found if "/shuffle_" in f}

    for _ in range(5):
        before = files()
        out = written(table(spark, DATA, "documents").repartition(3, "doc_id"))
        assert not files() - before and out.count() == 200
    frame = table(spark, DATA, "documents").repartition(3, "doc_id")  # a frame stays of use, before and after it is written
    assert len(frame.collect()) == written(frame).count() == len(frame.collect())


def test_a_large_group_is_not_linked_anew_in_each_band(spark, monkeypatch):
    monkeypatch.setattr(near, "TASK_ENTRIES", 500)
    rng, made, links_of = random.Random(12), [], near.loose_links
    monkeypatch.setattr(near, "loose_links", lambda *a: made.append(links_of(*a)) or made[-1])
    base = B.text(rng, 120, 10**6).split()
    rows = [(i, " ".join([*base[: i % 120], f"new{i}", *base[i % 120 + 1 :]])) for i in range(600)]
    rows += [(1000 + i, B.text(rng, 90, 10**6)) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(B.frame(spark, rows)).collect()}
    assert got == {k: 0 if k < 1000 else k for k, _ in rows}
    assert 599 <= sum(f.count() for f in made) < 10 * 600  # some bands times 600 before


@pytest.mark.parametrize("centres", [1, 5, 300])
def test_sweep_links_what_all_pairs_link(centres):
    rng = np.random.default_rng(centres)
    check = rng.integers(0, 2**63, (centres, 2), dtype=np.uint64)[rng.integers(0, centres, 300)]
    for row in check:
        for b in rng.integers(0, 128, 24):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    who, got, expected = rng.integers(0, 250, 300), simhash.Stars(300), simhash.Stars(300)
    near.sweep(who, check, got)
    i, j = np.triu_indices(300, 1)
    alike = np.bitwise_count(check[i] ^ check[j]).sum(axis=1) <= near.LOOSE
    expected.link(who[i[alike]], who[j[alike]])
    assert (got.roots(np.arange(300)) == expected.roots(np.arange(300))).all()
