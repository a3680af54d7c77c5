"""Retrieval benchmarks: a JSON array of questions with the sessions they are asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "question_id string, question_type string, question string, answer string, question_date string, "
    "haystack_dates array<string>, haystack_sessions array<array<struct<role: string, content: string>>>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).option("multiLine", True).json(path)


def moment(text: Column) -> Column:
    """`2023/05/20 (Sat) 02:21` as a timestamp; null for anything else."""
    kept = F.regexp_extract(text, r"^\s*(\d{4}/\d{2}/\d{2})\s+\([A-Za-z]+\)\s+(\d{2}:\d{2})\s*$", 1)
    hour = F.regexp_extract(text, r"^\s*(\d{4}/\d{2}/\d{2})\s+\([A-Za-z]+\)\s+(\d{2}:\d{2})\s*$", 2)
    return F.try_to_timestamp(F.concat_ws(" ", kept, hour), F.lit("yyyy/MM/dd HH:mm"))


def content_key(session: Column) -> Column:
    """A session's messages as a key: equal content is extracted once, whatever question it comes with."""
    return F.left(F.sha2(F.to_json(session), 256), F.lit(16))


def sessions_of(questions: DataFrame) -> DataFrame:
    """question_id, position, session_key, started and messages of every session of every question."""
    wide = questions.select("question_id", "haystack_dates", F.posexplode("haystack_sessions").alias("position", "messages"))
    return wide.select("question_id", F.col("position").cast("long").alias("position"), content_key(F.col("messages")).alias("session_key"), moment(F.get("haystack_dates", F.col("position"))).alias("started"), "messages")


def turns_of(sessions: DataFrame, project: str) -> DataFrame:
    """Messages as turns, a minute apart, of each distinct session once."""
    once = sessions.groupBy("session_key").agg(F.min_by(F.struct("started", "messages"), F.struct("question_id", "position")).alias("s"))
    each = once.select(F.col("session_key").alias("session_id"), F.col("s.started").alias("started"), F.posexplode("s.messages").alias("turn", "m"))
    return each.select("session_id", F.lit(project).alias("project"), F.col("turn").cast("long").alias("line_no"), F.col("m.role").alias("speaker"), F.col("m.content").alias("text"), (F.col("started") + F.make_dt_interval(mins=F.col("turn"))).alias("ts"))


def uncached(sessions: DataFrame, cache: DataFrame) -> DataFrame:
    """Sessions whose key is not in the extraction cache (session_key)."""
    return sessions.join(cache.select("session_key").distinct(), "session_key", "left_anti")


def facts_of(sessions: DataFrame, cache: DataFrame) -> DataFrame:
    """Each question's facts, from the cache (session_key, text, ...) by content."""
    return sessions.select("question_id", "position", "session_key").join(cache, "session_key")


def sizes(sessions: DataFrame) -> DataFrame:
    """questions, sessions, distinct sessions and turns of the distinct ones, as one row."""
    once = sessions.groupBy("session_key").agg(F.max(F.size("messages")).alias("turns"))
    return sessions.agg(F.countDistinct("question_id").alias("questions"), F.count("*").alias("sessions")).crossJoin(once.agg(F.count("*").alias("distinct_sessions"), F.coalesce(F.sum("turns"), F.lit(0)).cast("long").alias("turns")))
