"""A stream of immutable turn batches into the store, for sources that only add files.

Grown files are found by the batch path (operators.ingest); a file stream does not
read a file again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from turnstone.functions import text as T

TURN = "session_id string, project string, turn_id long, ts timestamp, speaker string, text string"


def turn_stream(spark: SparkSession, path: str, watermark: str = "1 day") -> DataFrame:
    """Turns from JSON files under path, each (session_id, turn_id) once within the watermark."""
    read = spark.readStream.schema(TURN).json(path)
    spoken = read.where("speaker IN ('user', 'assistant')").withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    return spoken.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "turn_id"])


def drain(turns: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands everything that is there to sink(batch, batch_id), then ends; the checkpoint remembers what was read."""
    return turns.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
