"""Ingestion from files to tables, twice over, with and without models."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_sources import say, write

from turnstone import cli
from turnstone.operators import catalog as C
from turnstone.operators import edus as E
from turnstone.operators import ingest as I
from turnstone.operators import recall as R
from turnstone.operators import reports as P
from turnstone.sources import questions as B
from turnstone.sources import sessions as S
from turnstone.sources.progress import InProgress
from turnstone.sources.store import Store

TURN = "session_id string, project string, turn_id long, ts timestamp, speaker string, text string"


def turns(spark, texts, session="s"):
    return spark.createDataFrame([(session, "p", i, datetime(2024, 1, 1, 0, i), "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)], TURN)


def test_ids_do_not_clash_between_passes(spark):
    spoken = turns(spark, ["alpha beta", "alpha beta\ngamma", "other things", "alpha beta"])
    first = I.process(spoken.where("turn_id < 2"), None).facts
    state = spark.createDataFrame([("s", 2, first.count())], "session_id string, turn_count long, edu_count long")
    second = I.process(spoken, state).facts
    both = first.unionByName(second)
    assert both.select("edu_id").distinct().count() == both.count() == 4
    assert sorted(r["edu_seq"] for r in both.collect()) == [0, 1, 2, 3]
    assert not {r["trajectory_id"] for r in first.collect()} & {r["trajectory_id"] for r in second.collect()}
    again = I.process(spoken, state).facts
    assert sorted(map(str, again.collect())) == sorted(map(str, second.collect()))
    assert I.process(spoken, state, known=first).facts.count() == 1


def sessions(tmp_path, more=False):
    root = tmp_path / "logs"
    lines = [say("user", "I prefer tabs\nthe river froze", "2024-05-01T10:00:00Z"), say("assistant", "noted: tabs", "2024-05-01T10:01:00Z")]
    write(root, "-home-ann-proj", "s1", lines + ([say("user", "the bridge burned", "2024-05-02T10:00:00Z")] if more else []))
    write(root, "-home-ann-a%b", "s2", [say("user", "another project entirely", "2024-05-03T10:00:00Z")])
    write(root, "-home-ann-proj", "empty", [say("system", "x")])
    return str(root)


def test_ingest_twice(spark, tmp_path):
    store, root, folder = Store(spark, str(tmp_path / "store")), sessions(tmp_path), str(tmp_path / "catalogs")
    said = []
    done = I.ingest_all(spark, root, store, catalogs=folder, as_of="2024-06-01", progress=said.append)
    assert (done["pending"], done["sessions"], done["edus"], done["failed"]) == (3, 3, 4, 0) and said
    assert done["catalogs"] == {"proj": "rules", "a%b": "rules"}
    assert I.ingest_all(spark, root, store)["pending"] == 0
    sessions(tmp_path, more=True)
    done = I.ingest_all(spark, root, store, catalogs=folder, as_of="2024-06-01")
    assert (done["pending"], done["edus"]) == (1, 1) and done["catalogs"] == {"proj": "rules"}
    facts = store.table("edus", "proj").orderBy("edu_seq").collect()
    assert [(r["text"], r["turn_id"], r["edu_seq"]) for r in facts] == [("I prefer tabs", 0, 0), ("the river froze", 0, 1), ("noted: tabs", 1, 2), ("the bridge burned", 2, 3)]
    state = {r["session_id"]: r for r in store.table("ingestion_state").collect()}
    assert (state["s1"]["turn_count"], state["s1"]["edu_count"], state["empty"]["turn_count"]) == (3, 4, 0)
    before = sorted(r["edu_id"] for r in store.table("edus").collect())
    done = I.ingest_all(spark, root, store, force=True, exclude=["empty"])
    assert done["edus"] == 5 and sorted(r["edu_id"] for r in store.table("edus").collect()) == before  # the same ids, once
    assert {r["session_id"]: r["edu_count"] for r in store.table("ingestion_state").collect()}["s1"] == 4
    assert store.table("edu_vectors").count() == 5
    assert C.write_catalogs(spark, *(store.table(n) for n in ("edus", "trajectories")), store.table("trajectory_keywords"), folder, "2024-06-01") == {"proj": "unchanged", "a%b": "unchanged"}
    I.reset(store, I.reset_targets(store.table("ingestion_state"), prefix="s1"))
    assert {r["session_id"] for r in store.table("edus").collect()} == {"s2"} and {r["session_id"] for r in store.table("ingestion_state").collect()} == {"s2", "empty"}
    with pytest.raises(ValueError):
        I.reset_targets(store.table("ingestion_state"))


def test_failed_chunks_leave_the_session_pending(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "store")), sessions(tmp_path, more=True)

    def extractor(seen, core):
        if any("another" in t["text"] for t in seen):
            raise E.RateLimited
        return [{"text": f"fact {t['turn_id']}", "source_turn_ids": [t["turn_id"], 999, True, "x"], "tag": " Decision"} for t in seen if t["turn_id"] in core] + [{"text": "lost", "source_turn_ids": [77]}]

    hooks = I.Hooks(extractor=extractor, classifier=lambda window, rel: False, labeller=lambda project, facts, cloud: ("a label", ["Big Topic", " big topic", 3]))
    done = I.ingest_all(spark, root, store, hooks, core=2, margin=1)
    assert done["failed"] == 1 and done["rate_limited"] and done["edus"] == 3
    assert {r["session_id"] for r in store.table("ingestion_state").collect()} == {"s1", "empty"}
    assert [(r["text"], r["source_turn_ids"], r["tag"], r["speakers"]) for r in store.table("edus").orderBy("edu_seq").collect()] == [("fact 0", [0], "decision", ["user"]), ("fact 1", [0 + 1], "decision", ["assistant"]), ("fact 2", [2], "decision", ["user"])]
    assert store.table("trajectories").count() == 3 and {r["keyword"] for r in store.table("trajectory_keywords").collect()} == {"big-topic"}
    assert I.ingest_all(spark, root, store)["sessions"] == 1  # the rest, by rules


def test_hooks_fall_back(spark):
    facts = I.process(turns(spark, ["a b", "c d", "e f"]), None).facts

    def broken(*_):
        raise RuntimeError

    assert {r["same"] for r in E.classify_with(facts.drop("same"), broken).where("edu_seq > 0").collect()} == {True}
    assert {r["same"] for r in E.classify_with(facts, lambda *_: "no").where("edu_seq > 0").collect()} == {True}
    row = E.label_with(E.segment(facts.withColumn("same", F.lit(True))), broken).first()
    assert row["summary"] == "(unlabeled trajectory of 3 EDUs)" and row["keywords"] == ["uncategorized"]


def test_citations_keep_their_order(spark):
    raw = spark.createDataFrame([("s", 0, 0, " x ", ["2", "0", "9", "1.5", "no"], "gotcha", False), ("s", 0, 1, "y", ["7"], None, False)], "session_id string, chunk long, pos long, text string, source_turn_ids array<string>, tag string, failed boolean")
    row, = E.cited(raw, turns(spark, ["a", "b", "c"])).collect()
    assert (row["source_turn_ids"], row["ts"], row["speakers"], row["turn_id"], row["text"]) == ([2, 0, 1], datetime(2024, 1, 1, 0, 2), ["assistant", "user"], 0, "x")


def test_progress_markers(spark, tmp_path):
    mine, other = InProgress(spark, str(tmp_path)), InProgress(spark, str(tmp_path))
    mine.mark(["a", "b"])
    assert other.sessions() == {"a", "b"}
    path = tmp_path / "_in_progress" / mine.mine
    path.write_text(json.dumps(json.loads(path.read_text()) | {"pid": 2**22 + 5}))
    for crc in (tmp_path / "_in_progress").glob(".*.crc"):
        crc.unlink()
    assert other.sessions() == set() and not path.exists()


def test_recall_and_catalog_from_a_store(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "catalogs")
    I.ingest_all(spark, sessions(tmp_path, more=True), store)
    tables = [store.table(n) for n in ("edus", "trajectories", "trajectory_keywords", "edu_vectors")]
    logged = []
    found = R.recall(spark, *tables, ["bridge", " "], "where is the river", log=logged.append)
    assert "the bridge burned" in found.text and found.hits[0][1] == 1.0 and found.blocks >= 1
    assert logged[0]["hits"] == len(found.hits) and logged[0]["terms"] == ["bridge"]

    def no_log(_):
        raise OSError

    with pytest.warns(UserWarning):
        assert R.recall(spark, *tables, [], "", log=no_log).text == R.NOTHING
    words = tables[2]
    answer = {"project_overview": "about rivers", "available_memories": [{"tag": "Decision", "count": "2"}]}
    assert C.write_catalogs(spark, tables[0], tables[1], words, folder, "2024-06-01", ["proj"], lambda p, prompt: answer if "river" in prompt else None) == {"proj": "curator"}
    assert "about rivers" in C.opening(spark, folder, "proj") and C.opening(spark, folder, "none") == ""
    assert C.write_catalogs(spark, tables[0], tables[1], words, folder, "2024-06-01", ["proj"]) == {"proj": "unchanged"}
    with pytest.warns(UserWarning):
        assert C.write_catalogs(spark, tables[0], tables[1], words, folder, "2024-06-01", ["a%b"], lambda *_: 1 / 0) == {"a%b": "rules"}


def test_command_line(spark, tmp_path):
    root, store, folder = sessions(tmp_path), str(tmp_path / "store"), str(tmp_path / "catalogs")

    def run(*args):
        return cli.run(spark, ["--store", store, *args])

    assert run("stats") == "the store is empty"
    assert "new 3" in run("status", "--sessions", root)
    assert len(run("status", "--sessions", root, "--table").splitlines()) == 3
    assert json.loads(run("ingest", "--sessions", root))["edus"] == 4
    assert run("stats").startswith("4 facts, ") and "proj: 2" in run("stats")
    assert "river" in run("search", "the river", "--strict", "proj").splitlines()[1]
    assert "tabs" in run("recall", "tabs") and run("recall", "nothing") == R.NOTHING
    lines = run("sessions", "--sessions", root, "--sort", "edus").splitlines()
    assert len(lines) == 3 and lines[0].startswith("2024-05-01") and lines[-1].startswith("total")
    assert run("dump", "--project", "proj").splitlines()[0] == "[proj, 2024-05-01] I prefer tabs" or "[proj, 2024-05-01]" in run("dump")
    assert {json.loads(x)["tag"] for x in run("dump", "--json").splitlines()} == {"project"}
    assert run("reindex", "--catalogs", folder) == "a%b: rules\nproj: rules" and run("reindex", "--catalogs", folder, "--project", "proj") == "proj: unchanged"
    assert run("reset", "--project", "proj") == "2 sessions forgotten" and run("reset", "--session", "s2", "--state-only") == "1 sessions forgotten"
    assert run("stats").startswith("1 facts")
    assert run("reset", "--all") == "all forgotten" and run("stats") == "the store is empty"


def test_large_files_keep_their_lines_in_order(spark, tmp_path):
    write(tmp_path, "p", "long", [say("user", f"line {i}") for i in range(4000)])
    with_small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = S.read_turns(spark, str(tmp_path)).orderBy("turn_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_small)
    assert [r["text"] for r in rows] == [f"line {i}" for i in range(4000)]
    counted = S.bad_lines(S.read_lines(spark, str(tmp_path))).first()
    assert (counted["lines"], counted["bad"]) == (4000, 0)


def test_questions(spark, tmp_path):
    talk = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]
    held = [{"question_id": "q1", "question_type": "t", "question": "?", "answer": "!", "question_date": "2023/05/21 (Sun) 02:21", "haystack_dates": ["2023/05/20 (Sat) 02:21", "bad"], "haystack_sessions": [talk, talk[:1]]}, {"question_id": "q2", "haystack_dates": [], "haystack_sessions": [talk]}]
    (tmp_path / "q.json").write_text(json.dumps(held))
    found = B.sessions_of(B.read_questions(spark, str(tmp_path / "q.json")))
    assert tuple(B.sizes(found).first()) == (2, 3, 2, 3)
    spoken = B.turns_of(found, "bench").orderBy("session_id", "line_no").collect()
    assert len(spoken) == 3 and spoken[0]["ts"] is None or len(spoken) == 3
    cache = found.where("position = 0").select("session_key", F.lit("f").alias("text"))
    assert {(r["question_id"], r["position"]) for r in B.uncached(found, cache).collect()} == {("q1", 1)}
    assert B.facts_of(found, cache.distinct()).count() == 2


def test_texts_for_people(spark):
    from pyspark.sql import Row

    assert P.search_text([]) == "no results"
    assert P.search_text([Row(score=0.5, project="p", ts=datetime(2024, 1, 1), similarity=0.5, recency_weight=1.0, project_boost=1.0, text="x")]).endswith("\n   x")
    table = P.accuracy_text([Row(kind=None, correct=3, questions=4, accuracy=0.75), Row(kind="a", correct=1, questions=2, accuracy=0.5)], "kind")
    assert table.splitlines()[1].startswith("a ") and table.splitlines()[2].split() == ["all", "3", "4", "75.0%"]
