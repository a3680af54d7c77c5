import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnstone.operators import ingest as I
from turnstone.sources import files
from turnstone.sources import sessions as S
from turnstone.sources.store import SCHEMA_VERSION, Store
from turnstone.streaming.turns import drain, turn_stream


def write(folder, project, session, lines):
    path = folder / project / f"{session}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return path


def say(kind, content, ts="2024-05-01T10:00:00Z", **more):
    return {"type": kind, "message": {"content": content}, "timestamp": ts} | more


def test_sessions(spark, tmp_path):
    blocks = [{"type": "text", "text": "one"}, {"type": "tool_use", "id": 1}, {"type": "text", "text": "two "}]
    write(tmp_path, "-home-ann-proj", "s1", [
        say("user", "  hello \n", gitBranch="main"), "", "{not json", say("system", "no"), say("assistant", blocks, "2024-05-01T12:00:00.5+02:00"), say("user", [{"type": "tool_result", "content": "x"}]),
        "17", {"type": "user", "message": None, "timestamp": "2024-05-01T10:00:00Z"}, {"type": "user", "message": {"content": "no time"}}, say("user", "last"),
    ])
    write(tmp_path, "-home-ann", "empty", [say("system", "x")])
    rows = S.read_turns(spark, str(tmp_path)).orderBy("turn_id").collect()
    assert [(r["session_id"], r["project"], r["turn_id"], r["speaker"], r["text"]) for r in rows] == [("s1", "proj", 0, "user", "hello"), ("s1", "proj", 1, "assistant", "one\ntwo"), ("s1", "proj", 2, "user", "last")]
    assert rows[0]["git_branch"] == "main" and rows[1]["git_branch"] is None
    assert rows[1]["ts"] == datetime(2024, 5, 1, 10, 0, 0, 500000)


def test_signatures_and_pending(spark, tmp_path):
    path = write(tmp_path, "p", "s1", [say("user", "x" * 500)])
    short = write(tmp_path, "p", "s2", ["a"])
    found = {r["session_id"]: r for r in S.signatures(spark, str(tmp_path)).collect()}
    for p in (path, short):
        raw = p.read_bytes()
        assert found[p.stem]["hash"] == f"{len(raw)}:{hashlib.md5(raw[-128:]).hexdigest()}"
    state = spark.createDataFrame([("s1", found["s1"]["hash"], 1), ("s2", "other", 4)], "session_id string, hash string, turn_count long")
    rows = I.pending(S.signatures(spark, str(tmp_path)), state).collect()
    assert [(r["session_id"], r["old_turn_count"], r["status"]) for r in rows] == [("s2", 4, "updated")]
    forced = I.pending(S.signatures(spark, str(tmp_path)), state, force=True).collect()
    assert sorted((r["session_id"], r["old_turn_count"], r["status"]) for r in forced) == [("s1", 0, "new"), ("s2", 0, "new")]


NAMES = ["p", "q", "a=b", "a%b", "x/y", "c:d", "007", "12", "", " ", None]


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root)
    rows = [(f"t{i}{k}", f"s{i}{k}", p, 1) for i, p in enumerate(NAMES) for k in "ab"]
    paths = spark.createDataFrame(rows, "trajectory_id string, session_id string, project string, n int")
    words = paths.select("trajectory_id", "project", F.lit("k").alias("keyword"))
    store.upsert("trajectories", paths, "trajectory_id")
    store.append("trajectory_keywords", words)
    store.append("edus", paths.select("session_id", "project", F.col("trajectory_id").alias("edu_id")))
    store.upsert("trajectories", spark.createDataFrame([("t0a", "s0a", "q", 5)], paths.schema), "trajectory_id")
    got = {r["trajectory_id"]: (r["project"], r["n"]) for r in store.table("trajectories").collect()}
    assert got == {t: ("q", 5) if t == "t0a" else (p, n) for t, _, p, n in rows}  # names come back as they were
    assert [r["trajectory_id"] for r in store.table("trajectories", "007").orderBy("trajectory_id").collect()] == ["t6a", "t6b"]
    store.delete_sessions(spark.createDataFrame([(f"s{i}a",) for i in range(len(NAMES))], "session_id string"))
    for name, column in (("trajectories", "trajectory_id"), ("trajectory_keywords", "trajectory_id"), ("edus", "edu_id")):
        assert sorted(r[column] for r in store.table(name).collect()) == sorted(f"t{i}b" for i in range(len(NAMES)))
    store.compact("edus")
    store.clean()
    assert len(store.versions()) == 1 and store.table("edus").count() == len(NAMES)
    store.log("flags", [{"a": 1}])
    store.log("flags", [{"a": 2}])
    assert [r["a"] for r in store.read_log("flags")] == [1, 2]
    Store(spark, root)
    newest = tmp_path / "store" / "_manifest" / store.versions()[-1]
    held = json.loads(newest.read_text())
    files.write(spark, str(newest), json.dumps(held | {"schema_version": SCHEMA_VERSION + 1}))
    with pytest.raises(ValueError):
        Store(spark, root)
    (tmp_path / "old" / "edus").mkdir(parents=True)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "old"))


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("t", "p")], "trajectory_id string, project string")
    store.append("trajectories", rows)
    with pytest.raises(RuntimeError), store.commit() as change:
        change.upsert("trajectories", rows.withColumn("trajectory_id", F.lit("u")), "trajectory_id")
        raise RuntimeError
    assert [r["trajectory_id"] for r in store.table("trajectories").collect()] == ["t"]
    one, two = store.commit(), store.commit()
    one.append("trajectories", rows)
    two.append("trajectories", rows)
    one.__exit__(None, None, None)
    with pytest.raises(Exception):  # the second writer began from an older state
        two.__exit__(None, None, None)
    assert store.table("trajectories").count() == 2


def test_stream(spark, tmp_path):
    def batch(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("session_id", "project", "turn_id", "ts", "speaker", "text"), r))) for r in rows))

    seen = []
    sink = lambda df, _: seen.extend((r["session_id"], r["turn_id"]) for r in df.collect())
    batch("1.json", [("s", "p", 0, "2024-01-01T00:00:00Z", "user", "a"), ("s", "p", 0, "2024-01-01T00:00:00Z", "user", "a"), ("s", "p", 1, "2024-01-01T00:01:00Z", "system", "b")])
    drain(turn_stream(spark, str(tmp_path / "in")), sink, str(tmp_path / "ck")).awaitTermination()
    batch("2.json", [("s", "p", 2, "2024-01-01T00:02:00Z", "assistant", " c\t"), ("s", "p", 3, "2024-01-01T00:02:00Z", "user", "\t\n ")])
    drain(turn_stream(spark, str(tmp_path / "in")), sink, str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == [("s", 0), ("s", 2)]
