"""Incremental ingestion: what is pending, its state, and one pass over it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.functions.embedding import hashed
from turnstone.operators import catalog as C
from turnstone.operators import edus as E
from turnstone.operators import keywords as K
from turnstone.operators import turns as N
from turnstone.sources.progress import InProgress
from turnstone.sources.scratch import mark, release, written
from turnstone.sources.sessions import read_turns, signatures
from turnstone.sources.store import Store, merge_latest


def pending(signatures: DataFrame, state: DataFrame, exclude: DataFrame | None = None, in_progress: DataFrame | None = None, force: bool = False) -> DataFrame:
    """session_id, project, hash, old_turn_count, status (ingesting, new, updated) of sessions without state or with another hash."""
    found = signatures if exclude is None else signatures.join(exclude, "session_id", "left_anti")
    known = state.select("session_id", F.col("hash").alias("old_hash"), F.col("turn_count").alias("old_turn_count"))
    joined = found.join(known, "session_id", "left")
    changed = joined if force else joined.where(~F.col("hash").eqNullSafe(F.col("old_hash")))
    count = F.lit(0).cast("long") if force else F.coalesce("old_turn_count", F.lit(0)).cast("long")
    changed = changed.withColumn("old_turn_count", count)
    if in_progress is None:
        running = changed.withColumn("running", F.lit(False))
    else:
        running = changed.join(in_progress.select("session_id").distinct().withColumn("running", F.lit(True)), "session_id", "left")
    status = F.when(F.coalesce("running", F.lit(False)), F.lit("ingesting")).when(F.col("old_turn_count") == 0, F.lit("new")).otherwise(F.lit("updated"))
    return running.select("session_id", "project", "hash", "old_turn_count", status.alias("status"))


def breakdown(pending: DataFrame) -> DataFrame:
    return pending.agg(F.count("*").alias("pending"), *(F.count_if(F.col("status") == s).alias(s) for s in ("new", "updated", "ingesting")))


def status_order(status: str = "status"):
    """Ingesting before new before updated."""
    return F.when(F.col(status) == "ingesting", 0).when(F.col(status) == "new", 1).otherwise(2)


def state_after(state: DataFrame, done: DataFrame) -> DataFrame:
    """state with the sessions of done (session_id, project, hash, turn_count, edu_count, trajectory_count, partial) replaced; counts of facts and trajectories add up over passes."""
    old = state.select("session_id", F.col("edu_count").alias("e"), F.col("trajectory_count").alias("t"))
    summed = done.join(old, "session_id", "left").withColumn("edu_count", F.col("edu_count") + F.coalesce("e", F.lit(0))).withColumn("trajectory_count", F.col("trajectory_count") + F.coalesce("t", F.lit(0))).drop("e", "t")
    return merge_latest(state, summed.select(*state.columns), "session_id")


@dataclass
class Hooks:
    """Models in place of the defaults; embed makes a column of vectors from a column of texts."""

    extractor: Callable | None = None
    classifier: Callable | None = None
    labeller: Callable | None = None
    embed: Callable[[Column], Column] | None = hashed
    curator: Callable[[str, str], dict] | None = None


@dataclass
class Passed:
    facts: DataFrame
    trajectories: DataFrame
    keywords: DataFrame
    failed: DataFrame | None = None


def process(turns: DataFrame, state: DataFrame | None, force: bool = False, hooks: Hooks | None = None, cloud: DataFrame | None = None, known: DataFrame | None = None, core: int = N.CORE, margin: int = N.MARGIN, concurrency: int | None = None) -> Passed:
    """Facts, trajectories and trajectory keywords of the turns that aren't ingested yet.

    failed: session_id and limited of sessions of which a chunk failed; nothing of them is in the others.  cloud: project
    and keyword, shown to the labeller.  known: facts of earlier passes that aren't to be taken again."""
    hooks = hooks or Hooks()
    fresh = turns if state is None else N.new_turns(turns, state, force)
    failed = None
    if hooks.extractor is None:
        raw = E.line_facts(fresh).withColumn("tag", F.lit(T.DEFAULT_TAG))
    else:
        first = F.min("turn_id").over(Window.partitionBy("session_id"))  # chunks count from the first new turn
        moved = fresh.withColumn("_first", first).withColumn("_turn", F.col("turn_id") - F.col("_first"))
        bases = moved.groupBy("session_id").agg(F.min("_first").alias("_base"))
        said = written(E.extract_with(moved.drop("turn_id").withColumnRenamed("_turn", "turn_id"), hooks.extractor, core, margin, concurrency))
        failed = said.where("failed").groupBy("session_id").agg(F.max("limited").alias("limited"))
        inside = E.cited(said.join(failed, "session_id", "left_anti"), moved.drop("turn_id").withColumnRenamed("_turn", "turn_id"), core)
        raw = inside.join(bases, "session_id").withColumn("turn_id", F.col("turn_id") + F.col("_base")).withColumn("source_turn_ids", F.transform("source_turn_ids", lambda i: i + F.col("_base"))).drop("_base")
    start = None if state is None or force or "edu_count" not in state.columns else state.select("session_id", "edu_count")
    facts = E.dedup_facts(raw, known, start)
    judged = E.boundaries(facts) if hooks.classifier is None else E.classify_with(facts, hooks.classifier, concurrency=concurrency)
    facts = E.segment(judged).select(*FACT)
    if hooks.extractor is not None or hooks.classifier is not None:
        facts = written(facts)  # a model is asked once
    paths, words = E.trajectories(facts), E.trajectory_keywords(facts)
    if hooks.labeller is not None:
        paths, words = E.labelled(paths, written(E.label_with(facts, hooks.labeller, cloud, concurrency)))
    return Passed(facts, paths, words, failed)


FACT = ["edu_id", "session_id", "project", "ts", "turn_id", "source_turn_ids", "speakers", "tag", "text", "edu_seq", "trajectory_id", "trajectory_index"]


def complete(facts: DataFrame, chunks_failed: DataFrame) -> DataFrame:
    """Facts of sessions all of whose chunks succeeded; chunks_failed: session_id, failed."""
    bad = chunks_failed.where("failed").select("session_id").distinct()
    return facts.join(bad, "session_id", "left_anti")


def canonical(words: DataFrame, paths: DataFrame, store: Store) -> tuple[DataFrame, list[dict]]:
    """Trajectory keywords in the forms of their projects' stored clouds (a snapshot from before the pass), and the flags to log."""
    cloud = clouds(store)
    if cloud is None:  # an empty cloud accepts all
        return words, []
    placed = K.of_projects(words, paths)
    out, flags = None, []
    for project in [r["project"] for r in placed.select("project").distinct().collect()]:
        mine = placed.where(F.col("project").eqNullSafe(project))
        old = cloud.where(F.col("project").eqNullSafe(project)).select("keyword")
        mapping = written(K.canonicalize(mine.select("keyword"), old))
        flags += K.flag_records(mapping, project, datetime.now(UTC).isoformat(timespec="seconds"))
        done = K.rewrite(mine.select("trajectory_id", "keyword"), mapping)
        out = done if out is None else out.unionByName(done)
    return (words.limit(0) if out is None else out), flags


def clouds(store: Store) -> DataFrame | None:
    words = store.table("trajectory_keywords")
    return None if words is None else words.select("project", "keyword").distinct()


def ingest_all(spark: SparkSession, root: str, store: Store, hooks: Hooks | None = None, force: bool = False, exclude: list[str] | None = None, catalogs: str | None = None, as_of=None, progress: Callable[[str], None] | None = None, concurrency: int | None = None, core: int = N.CORE, margin: int = N.MARGIN) -> dict:
    """One pass over the session files below root: what is new or grown is read, turned into facts and trajectories, and stored with its state in one commit; then the touched projects' catalogs are rebuilt.

    A session of which a chunk fails keeps its old state and stays pending.  With force everything is read again and
    replaces what is stored.  Sessions that another live process ingests are left to it.  Gives the totals."""
    began, tell = time.perf_counter(), progress or (lambda _: None)
    hooks, held, markers = hooks or Hooks(), mark(), InProgress(spark, store.root)
    state = store.table("ingestion_state")
    empty = spark.createDataFrame([], STATE)
    gone = [*(exclude or []), *markers.sessions()]
    found = written(signatures(spark, root))
    left = spark.createDataFrame([(s,) for s in gone], "session_id string") if gone else None
    due = written(pending(found, empty if state is None else state, exclude=left, force=force).join(found.select("session_id", "path", "modified"), "session_id"))
    rows = due.select("session_id", "path").collect()  # a row a pending file, as the listing itself
    total = {"pending": len(rows), "sessions": 0, "trajectories": 0, "edus": 0, "failed": 0, "rate_limited": False, "catalogs": {}, "seconds": 0.0}
    if rows:
        markers.mark([r["session_id"] for r in rows])
        try:
            tell(f"reading {len(rows)} sessions")
            turns = written(read_turns(spark, root, [r["path"] for r in rows]))
            done = process(turns, None if state is None else due.select("session_id", F.col("old_turn_count").alias("turn_count")).join(state.select("session_id", "edu_count"), "session_id", "left"), force, hooks, clouds(store), core=core, margin=margin, concurrency=concurrency)
            facts, paths, words = written(done.facts), written(done.trajectories), written(done.keywords)
            tell("canonical keywords")
            words, flags = canonical(words, paths, store)
            words = written(K.of_projects(words, paths))
            failed = due.select("session_id").limit(0).withColumn("limited", F.lit(False)) if done.failed is None else done.failed
            bad = failed.collect()
            good = due.join(failed, "session_id", "left_anti")
            counted = good.join(turns.groupBy("session_id").agg(F.count("*").alias("turn_count")), "session_id", "left").join(facts.groupBy("session_id").agg(F.count("*").alias("e")), "session_id", "left").join(paths.groupBy("session_id").agg(F.count("*").alias("t")), "session_id", "left")
            old = (empty if state is None else state).select("session_id", F.col("edu_count").alias("_e"), F.col("trajectory_count").alias("_t"))
            before = (lambda c: F.lit(0)) if force else (lambda c: F.coalesce(F.col(c), F.lit(0)))
            states = counted.join(old, "session_id", "left").select(
                "session_id", "project", "hash", F.coalesce("turn_count", F.lit(0)).cast("long").alias("turn_count"), (F.coalesce("e", F.lit(0)) + before("_e")).cast("long").alias("edu_count"),
                (F.coalesce("t", F.lit(0)) + before("_t")).cast("long").alias("trajectory_count"), F.lit(False).alias("partial"), F.col("modified").alias("updated"), "path",
            )
            states = written(states)
            tell("storing")
            stale = good.select("session_id") if force else good.limit(0).select("session_id")
            replaced = store.table("trajectories")
            stale_paths = paths.limit(0).select("trajectory_id") if replaced is None else replaced.join(stale, "session_id", "left_semi").select("trajectory_id")
            with store.commit() as change:
                change.put("edus", facts, [(stale, "session_id"), (facts, "edu_id")])
                change.put("trajectories", paths, [(stale, "session_id"), (paths, "trajectory_id")])
                change.put("trajectory_keywords", words, [(stale_paths, "trajectory_id"), (paths, "trajectory_id")])
                if hooks.embed is not None:
                    vectors = facts.select("edu_id", "session_id", "project", "ts", "trajectory_id", "text", hooks.embed(F.col("text")).alias("embedding"))
                    change.put("edu_vectors", vectors, [(stale_paths, "trajectory_id"), (facts, "edu_id")])
                change.put("ingestion_state", states, [(states, "session_id")])
            store.log("keyword_flags", flags)
            counts = facts.agg(F.count("*").alias("e")).crossJoin(paths.agg(F.count("*").alias("t"))).first()
            total |= {"sessions": states.count(), "trajectories": counts["t"], "edus": counts["e"], "failed": len(bad), "rate_limited": any(r["limited"] for r in bad)}
            touched = [r["project"] for r in good.select("project").where("project IS NOT NULL").distinct().collect()]
            if catalogs is not None and touched:
                tell(f"catalogs of {len(touched)} projects")
                tables = [store.table(n) for n in ("edus", "trajectories", "trajectory_keywords")]
                total["catalogs"] = C.write_catalogs(spark, tables[0], tables[1], tables[2], catalogs, as_of or datetime.now(UTC), touched, hooks.curator)
        finally:
            markers.unmark()
    release(spark, held)
    total["seconds"] = round(time.perf_counter() - began, 3)
    return total


STATE = "session_id string, project string, hash string, turn_count long, edu_count long, trajectory_count long, partial boolean, updated timestamp, path string"


def reset_targets(state: DataFrame, prefix: str | None = None, project: str | None = None, partial: bool = False) -> DataFrame:
    """session_id of the sessions a reset means: those marked partial, or of a project, or whose id begins with prefix."""
    if partial:
        chosen = state.where("partial")
    elif project is not None:
        chosen = state.where(F.col("project") == project)
    elif prefix:
        chosen = state.where(F.col("session_id").cast("string").startswith(prefix))
    else:
        raise ValueError("name a session, a project, or partial")
    return chosen.select("session_id")


def reset(store: Store, targets: DataFrame, state_only: bool = False) -> None:
    """Forgets the targets' state and, unless state_only, all that was made of them, in one commit."""
    with store.commit() as change:
        if not state_only:
            change.delete_sessions(targets)
        change.delete("ingestion_state", targets, "session_id")
