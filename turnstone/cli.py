"""The command line: python -m turnstone.cli --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnstone.functions.embedding import hashed
from turnstone.operators import catalog, ingest, lookups, recall, reports, search
from turnstone.sources.progress import InProgress
from turnstone.sources.sessions import read_turns, signatures
from turnstone.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnstone")
    top.add_argument("--store", required=True, help="folder of the tables")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="read new and grown sessions")
    p.add_argument("--sessions", required=True)
    p.add_argument("--force", action="store_true")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--catalogs")
    p = sub.add_parser("search", help="the facts most like a question")
    p.add_argument("question")
    p.add_argument("--project", help="is boosted")
    p.add_argument("--strict", help="only this project")
    p.add_argument("--results", type=int, default=search.RESULTS)
    p = sub.add_parser("recall", help="what memory holds about terms and a question")
    p.add_argument("terms", nargs="*")
    p.add_argument("--question", default="")
    p.add_argument("--project")
    p.add_argument("--strict")
    sub.add_parser("stats", help="numbers of facts, trajectories and sessions")
    p = sub.add_parser("sessions", help="a table of the sessions")
    p.add_argument("--sessions", required=True)
    p.add_argument("--project")
    p.add_argument("--sort", choices=["date", "edus", "words"], default="date")
    p = sub.add_parser("status", help="what waits to be read")
    p.add_argument("--sessions", required=True)
    p.add_argument("--table", action="store_true")
    p = sub.add_parser("dump", help="all facts")
    p.add_argument("--project")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("reset", help="forget sessions")
    p.add_argument("--all", action="store_true")
    p.add_argument("--session", help="beginning of the ids")
    p.add_argument("--project")
    p.add_argument("--partial", action="store_true")
    p.add_argument("--state-only", action="store_true")
    p = sub.add_parser("reindex", help="write the catalogs of changed projects")
    p.add_argument("--catalogs", required=True)
    p.add_argument("--project", action="append")
    return top


def run(spark: SparkSession, argv: list[str]) -> str:
    """What a command prints."""
    args = parser().parse_args(argv)
    if args.command == "reset" and args.all:  # works whatever version the store has
        Store.wipe(bare(spark, args.store))
        return "all forgotten"
    store = Store(spark, args.store)
    edus, paths, words, state = (store.table(n) for n in ("edus", "trajectories", "trajectory_keywords", "ingestion_state"))
    if args.command == "ingest":
        return json.dumps(ingest.ingest_all(spark, args.sessions, store, force=args.force, exclude=args.exclude, catalogs=args.catalogs))
    if args.command == "status":
        return status(spark, store, args)
    if edus is None:
        return "the store is empty"
    if args.command == "search":
        asked = search.vector(spark.range(1).select(hashed(F.lit(args.question)).alias("v")).first()["v"])
        return reports.search_text(search.search(store.table("edu_vectors"), asked, datetime.now(UTC), args.project, args.strict, args.results).collect())
    if args.command == "recall":
        log = lambda record: store.log("recall", [record])
        return recall.recall(spark, edus, paths, words, store.table("edu_vectors"), args.terms, args.question, current_project=args.project, strict_project=args.strict, log=log).text
    if args.command == "stats":
        n = lookups.sizes(edus, paths).first()
        lines = [f"{n['edus']} facts, {n['trajectories']} trajectories, {state.count()} sessions"]
        return "\n".join(lines + [f"{r['project']}: {r['sessions']}" for r in reports.per_project(state).collect()])
    if args.command == "sessions":
        rows = reports.session_rows(read_turns(spark, args.sessions), edus, state, args.project, args.sort)
        return "\n".join(r["line"] for r in rows.toLocalIterator())
    if args.command == "dump":
        column = "json" if args.json else "line"
        return "\n".join(r[column] for r in lookups.dump(edus, args.project).toLocalIterator())
    if args.command == "reset":
        targets = ingest.reset_targets(state, args.session, args.project, args.partial)
        n = targets.count()
        if n:
            ingest.reset(store, targets, args.state_only)
        return f"{n} sessions forgotten"
    done = catalog.write_catalogs(spark, edus, paths, words, args.catalogs, datetime.now(UTC), args.project)
    return "\n".join(f"{p}: {source}" for p, source in sorted(done.items()))


def bare(spark: SparkSession, root: str) -> Store:
    store = Store.__new__(Store)
    store.spark, store.root = spark, root.rstrip("/")
    return store


def status(spark: SparkSession, store: Store, args) -> str:
    found, state, edus = signatures(spark, args.sessions), store.table("ingestion_state"), store.table("edus")
    running = InProgress(spark, store.root).sessions()
    marked = spark.createDataFrame([(s,) for s in running], "session_id string") if running else None
    due = ingest.pending(found, spark.createDataFrame([], ingest.STATE) if state is None else state, in_progress=marked)
    if args.table:
        return "\n".join(r["line"] for r in reports.pending_table(due, read_turns(spark, args.sessions)).toLocalIterator())
    n, latest = ingest.breakdown(due).first(), reports.latest_activity(found).first()["modified"]
    age = None if latest is None else (datetime.now() - latest).total_seconds()
    return reports.status_text(0 if edus is None else edus.count(), 0 if state is None else state.count(), age, n["new"], n["updated"], n["ingesting"])


def main() -> None:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(spark, sys.argv[1:]))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
