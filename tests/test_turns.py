import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from turnstone.operators import edus as E
from turnstone.operators import turns as N


def of_size(spark, sizes):
    return spark.createDataFrame([(s, t) for s, n in enumerate(sizes) for t in range(n)], "session_id long, turn_id long")


def plain_chunks(n, core, margin):
    return sorted((k, i, core * k <= i < core * k + core) for k in range(-(-n // core)) for i in range(max(0, core * k - margin), min(n, core * k + core + margin)))


def plain_overlap(n, size, overlap):
    out, at, k = [], 0, 0
    while n and (k == 0 or at + overlap < n):
        out += [(k, i) for i in range(at, min(n, at + size))]
        at, k = at + size - overlap, k + 1
    return out


def test_chunks(spark):
    sizes = [0, 1, 200, 201, 400, 401]
    rows = N.chunks(of_size(spark, sizes)).collect()
    for s, n in enumerate(sizes):
        assert sorted((r["chunk"], r["turn_id"], r["is_core"]) for r in rows if r["session_id"] == s) == plain_chunks(n, 200, 10)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(0, 25), min_size=1, max_size=4), core=st.integers(2, 6))
def test_cores_partition_turns(spark, sizes, core):
    rows = N.chunks(of_size(spark, sizes), core, 1).where("is_core").collect()
    assert sorted((r["session_id"], r["turn_id"]) for r in rows) == [(s, t) for s, n in enumerate(sizes) for t in range(n)]


def test_overlap(spark):
    sizes = [0, 1, 5, 6, 9, 13, 14]
    rows = N.overlap_chunks(of_size(spark, sizes), 5, 1).collect()
    for s, n in enumerate(sizes):
        assert sorted((r["chunk"], r["turn_id"]) for r in rows if r["session_id"] == s) == sorted(plain_overlap(n, 5, 1))
    with pytest.raises(ValueError):
        N.overlap_chunks(of_size(spark, [1]), 3, 3)


def test_new_turns(spark):
    state = spark.createDataFrame([(0, 2)], "session_id long, turn_count long")
    turns = of_size(spark, [3, 2])
    assert sorted((r[0], r[1]) for r in N.new_turns(turns, state).select("session_id", "turn_id").collect()) == [(0, 2), (1, 0), (1, 1)]
    assert N.new_turns(turns, state, force=True).count() == 5


def test_dedup_keeps_first_valid(spark):
    facts = spark.createDataFrame([(1, "p", 0, 0, "A b", [9]), (1, "p", 1, 0, "a B ", [1]), (1, "p", 2, 0, "c", [2, 9])], "session_id long, project string, turn_id long, pos long, text string, source_turn_ids array<long>")
    from pyspark.sql import functions as F

    kept = E.dedup_facts(E.clip_citations(facts, F.lit(0), F.lit(5))).orderBy("edu_seq").collect()
    assert [(r["text"], r["source_turn_ids"], r["edu_seq"]) for r in kept] == [("a B ", [1], 0), ("c", [2], 1)]


def test_segments(spark):
    rows = spark.createDataFrame([(1, i, f"e{i}", same) for i, same in enumerate([None, True, False, None, False])], "session_id long, edu_seq long, edu_id string, same boolean")
    got = E.segment(rows).orderBy("edu_seq").collect()
    assert [(r["grp"], r["trajectory_index"]) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
