"""Turns: cleaning, numbering, chunking, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T

CORE, MARGIN = 200, 10
LEGACY_SIZE, LEGACY_OVERLAP = 200, 5


def number_turns(messages: DataFrame, order: str) -> DataFrame:
    """messages (session_id, speaker, text, ...) of users and assistants that are not blank, with a dense turn_id from 0 in each session."""
    kept = messages.where(F.col("speaker").isin("user", "assistant")).withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    return kept.withColumn("turn_id", (F.row_number().over(Window.partitionBy("session_id").orderBy(order)) - 1).cast("long"))


def chunks(turns: DataFrame, core: int = CORE, margin: int = MARGIN) -> DataFrame:
    """session_id, chunk, turn_id, is_core: cores of `core` turns, each with up to `margin` turns of context on both sides."""
    if margin > core:
        raise ValueError("margin must not exceed core")
    n = F.count("*").over(Window.partitionBy("session_id"))
    at = F.col("turn_id")
    wide = turns.select("session_id", "turn_id", n.alias("n"))
    last = F.floor((F.col("n") - 1) / core)
    first = F.greatest(F.lit(0), F.floor((at - margin) / core))
    near = F.explode(F.sequence(first.cast("long"), F.least(last, F.floor((at + margin) / core)).cast("long")))
    return wide.select("session_id", near.alias("chunk"), "turn_id").withColumn("is_core", F.col("chunk") == F.floor(at / core))


def overlap_chunks(turns: DataFrame, size: int = LEGACY_SIZE, overlap: int = LEGACY_OVERLAP) -> DataFrame:
    """session_id, chunk, turn_id: chunks of `size` turns, each beginning `size - overlap` after the one before; the last reaches the end."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be below size")
    n = F.count("*").over(Window.partitionBy("session_id"))
    wide = turns.select("session_id", "turn_id", n.alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("turn_id") - size + 1) / stride))
    placed = wide.select("session_id", "turn_id", "n", F.explode(F.sequence(first.cast("long"), F.floor(F.col("turn_id") / stride).cast("long"))).alias("chunk"))
    return placed.where((F.col("chunk") == 0) | (F.col("chunk") * stride + overlap < F.col("n"))).select("session_id", "chunk", "turn_id")


def chunk_counts(turns: DataFrame, core: int = CORE) -> DataFrame:
    counted = turns.groupBy("session_id").agg(F.count("*").alias("turns"))
    return counted.withColumn("chunks", F.ceil(F.col("turns") / core).cast("long"))


def new_turns(turns: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """The turns beyond each session's stored turn_count; all of a session without state, or with force."""
    if force:
        return turns
    seen = turns.join(state.select("session_id", "turn_count"), "session_id", "left")
    return seen.where(F.col("turn_id") >= F.coalesce("turn_count", F.lit(0))).drop("turn_count")


def session_stats(turns: DataFrame, edus: DataFrame) -> DataFrame:
    """Turns, words and facts of each session, and a row of totals with a null session_id."""
    words = turns.select("session_id", T.word_count(F.col("text")).alias("words"))
    by_session = words.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum("words").alias("words"))
    facts = edus.groupBy("session_id").agg(F.count("*").alias("edus"))
    joined = by_session.join(facts, "session_id", "left").withColumn("edus", F.coalesce("edus", F.lit(0)))
    return joined.groupingSets([["session_id"], []], "session_id").agg(F.sum("turns").alias("turns"), F.sum("words").alias("words"), F.sum("edus").alias("edus"))
