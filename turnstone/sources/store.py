"""Tables in Parquet with atomic commits, point reads, upserts and deletes.

A table is a set of segments, folders of Parquet files split by a hash of the
project.  A manifest names the segments that count and, for each, the projects
that a later commit has replaced; whatever a commit changes, in however many
tables, appears when its manifest does.  Rewriting touches only the projects it
must.  The project itself is a column of the files, so names of any kind, blank
and null ones too, come back as they were.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnstone.sources import files

SCHEMA_VERSION = 2
KEY = "_project"
CHILDREN = {"trajectory_keywords": "trajectory_id", "edu_vectors": "trajectory_id"}


def project_key(project) -> Column:
    """The folder of a project: a hash, so that no character of its name matters; null has its own."""
    column = F.col(project) if isinstance(project, str) else project
    return F.coalesce(F.md5(column.cast("string")), F.lit("none"))


class Commit:
    """Changes to tables that appear together.  Reads within see the state before."""

    def __init__(self, store: Store):
        found = store.manifest()
        self.store, self.tables, self.number, self.made = store, found["tables"], found["number"], []
        self.changed: set[str] = set()

    def append(self, name: str, rows: DataFrame) -> None:
        segment = uuid.uuid4().hex
        self.made.append(f"{self.store.root}/{name}/_segment={segment}")
        rows.withColumn(KEY, project_key("project")).write.partitionBy(KEY).parquet(self.made[-1])
        entry = self.tables.setdefault(name, {"schema": rows.schema.jsonValue(), "segments": []})
        entry["segments"].append({"id": segment, "without": []})

    def put(self, name: str, rows: DataFrame | None, drop: list[tuple[DataFrame, str]]) -> None:
        """Drops the rows whose key is among keys, for each (keys, key) of drop, and adds rows; only the projects that hold any of them are rewritten.  Once a table in a commit."""
        if name in self.changed:
            raise ValueError(f"{name} is changed twice in one commit")
        self.changed.add(name)
        old = self.store.table(name)
        if old is None:
            if rows is not None:
                self.append(name, rows)
            return
        kept, folders = old, [] if rows is None else [rows.select(project_key("project").alias("k"))]
        for keys, key in drop:
            doomed = keys.select(key).where(F.col(key).isNotNull()).distinct()
            folders.append(old.join(doomed, key, "left_semi").select(project_key("project").alias("k")))
            kept = kept.join(doomed, key, "left_anti")
        touched = sorted({r["k"] for f in folders for r in f.distinct().collect()})  # names of folders
        if not touched:
            return
        kept = kept.where(project_key("project").isin(touched)).select(*old.columns)
        for segment in self.tables[name]["segments"]:
            segment["without"] = sorted({*segment["without"], *touched})
        self.append(name, kept if rows is None else kept.unionByName(rows))

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        """Rows replace those of the same key, whatever their project; give each key once."""
        self.put(name, rows, [(rows, key)])

    def delete(self, name: str, keys: DataFrame, key: str) -> None:
        """Removes the rows whose key is among keys (a column of that name)."""
        self.put(name, None, [(keys, key)])

    def delete_sessions(self, sessions: DataFrame, children: dict[str, str] | None = None) -> None:
        """Removes the sessions' facts and trajectories, and what hangs on the trajectories (table: its key column)."""
        paths = self.store.table("trajectories")
        if paths is not None:
            gone = paths.join(sessions.select("session_id"), "session_id", "left_semi").select("trajectory_id")
            for name, key in (children or CHILDREN).items():
                self.delete(name, gone.withColumnRenamed("trajectory_id", key), key)
        for name in ("edus", "trajectories"):
            self.delete(name, sessions, "session_id")

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            for path in self.made:
                files.delete(self.store.spark, path)
            return
        self.store._publish(self.tables, self.number + 1)


class Store:
    """Tables under one root; refuses a root of another schema version, or one with tables and no version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        found = self.manifest()
        if found["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"store has schema version {found['schema_version']}, this code has {SCHEMA_VERSION}")

    def versions(self) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.root}/_manifest") if n.endswith(".json")]

    def manifest(self) -> dict:
        """The newest manifest; that of an empty store where there is none."""
        held = self.versions()
        if not held:
            foreign = [n for n in files.names(self.spark, self.root) if not n.startswith(("_", "."))]
            return {"schema_version": None if foreign else SCHEMA_VERSION, "number": 0, "tables": {}}
        return json.loads(files.read(self.spark, f"{self.root}/_manifest/{held[-1]}"))

    def _publish(self, tables: dict, number: int) -> None:
        """Another writer's commit in between makes the number taken, and this one an error."""
        files.write(self.spark, f"{self.root}/_manifest/{number:012d}.json", json.dumps({"schema_version": SCHEMA_VERSION, "number": number, "tables": tables}), replace=False)

    def commit(self) -> Commit:
        return Commit(self)

    def table(self, name: str, project: str | None = None) -> DataFrame | None:
        """A table's rows, of one project only if given (no other folder is read); None if it was never written."""
        entry = self.manifest()["tables"].get(name)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        full = StructType([*schema.fields, StructField("_segment", StringType()), StructField(KEY, StringType())])
        paths = [f"{self.root}/{name}/_segment={s['id']}" for s in entry["segments"]]
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(*paths)
        for segment in entry["segments"]:
            if segment["without"]:
                rows = rows.where((F.col("_segment") != segment["id"]) | ~F.col(KEY).isin(segment["without"]))
        if project is not None:
            rows = rows.where((F.col(KEY) == project_key(F.lit(project))) & (F.col("project") == project))
        return rows.select(*schema.names)

    def compact(self, name: str) -> None:
        """One segment of all rows that count; readers of older manifests go on until clean."""
        rows = self.table(name)
        if rows is not None:
            change = self.commit()
            change.tables.pop(name)
            with change:
                change.append(name, rows)

    def clean(self) -> None:
        """Deletes segments and manifests that the newest manifest doesn't name; only without other users."""
        held = self.versions()
        live = {f"_segment={s['id']}" for t in self.manifest()["tables"].values() for s in t["segments"]}
        for name in self.manifest()["tables"]:
            for segment in files.names(self.spark, f"{self.root}/{name}"):
                if segment.startswith("_segment=") and segment not in live:
                    files.delete(self.spark, f"{self.root}/{name}/{segment}")
        for old in held[:-1]:
            files.delete(self.spark, f"{self.root}/_manifest/{old}")

    def wipe(self) -> None:
        """All tables, logs and manifests."""
        for name in files.names(self.spark, self.root):
            files.delete(self.spark, f"{self.root}/{name}")

    # single changes as commits of their own

    def append(self, name: str, rows: DataFrame) -> None:
        with self.commit() as change:
            change.append(name, rows)

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        with self.commit() as change:
            change.upsert(name, rows, key)

    def delete_sessions(self, sessions: DataFrame, children: dict[str, str] | None = None) -> None:
        with self.commit() as change:
            change.delete_sessions(sessions, children)

    def log(self, name: str, rows: list[dict]) -> None:
        """Appends records to a log of JSON lines."""
        if rows:
            files.append(self.spark, f"{self.root}/_logs/{name}", "\n".join(json.dumps(r, default=str) for r in rows) + "\n")

    def read_log(self, name: str) -> list[dict]:
        folder = f"{self.root}/_logs/{name}"
        return [json.loads(line) for n in files.names(self.spark, folder) for line in files.read(self.spark, f"{folder}/{n}").splitlines()]


def merge_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key isn't among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
