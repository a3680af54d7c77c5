"""Point reads of stored facts and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_keywords(trajectories: DataFrame, keywords: DataFrame) -> DataFrame:
    """Trajectories with their keywords as a sorted array, empty where there are none."""
    words = keywords.groupBy("trajectory_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return trajectories.join(words, "trajectory_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def of_session(edus: DataFrame, session) -> DataFrame:
    """A session's facts in order."""
    return edus.where(F.col("session_id") == session).orderBy("edu_seq")


def of_trajectories(edus: DataFrame, ids: DataFrame) -> DataFrame:
    """The facts of a set of trajectories (column trajectory_id), by trajectory and place in it."""
    return edus.join(ids.select("trajectory_id").distinct(), "trajectory_id", "left_semi").orderBy("trajectory_id", "trajectory_index")


def by_ids(trajectories: DataFrame, keywords: DataFrame, ids: DataFrame) -> DataFrame:
    """The trajectories of a set of ids, with keywords; unknown ids give nothing, repeated ones one row."""
    wanted = ids.select("trajectory_id").distinct()
    return with_keywords(trajectories.join(wanted, "trajectory_id", "left_semi"), keywords.join(wanted, "trajectory_id", "left_semi"))


def in_session(trajectories: DataFrame, session) -> DataFrame:
    return trajectories.where(F.col("session_id") == session).orderBy("start_turn", "trajectory_id")


def of_project(trajectories: DataFrame, project: str, limit: int | None = None) -> DataFrame:
    """A project's trajectories, newest first; the first `limit` if given."""
    found = trajectories.where(F.col("project") == project).orderBy(F.desc("created_at"), "trajectory_id")
    return found if limit is None else found.limit(limit)


def projects(trajectories: DataFrame) -> DataFrame:
    return trajectories.select("project").distinct().orderBy("project")


def sizes(edus: DataFrame, trajectories: DataFrame) -> DataFrame:
    """edus and trajectories, how many there are, as one row."""
    both = edus.select(F.lit(1).alias("e"), F.lit(0).alias("t")).unionByName(trajectories.select(F.lit(0).alias("e"), F.lit(1).alias("t")))
    return both.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("edus"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("trajectories"))


def dump(edus: DataFrame, project: str | None = None) -> DataFrame:
    """All facts, or a project's, in order of time, with the line that shows one and the JSON of one."""
    chosen = edus if project is None else edus.where(F.col("project") == project)
    line = F.concat(F.lit("["), F.coalesce("project", F.lit("?")), F.lit(", "), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), "text")
    held = ["edu_id", "session_id", "project", "ts", "tag", "source_turn_ids", "trajectory_id", "trajectory_index", "text"]
    return chosen.select("edu_id", "ts", line.alias("line"), F.to_json(F.struct(*held)).alias("json")).orderBy("ts", "edu_id")
