"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from turnstone.sources import files

#: What written has written and release has not deleted, in order.
HELD: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a temporary folder, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="turnstone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/turnstone-{uuid.uuid4().hex}"
    HELD.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of what is held, for release."""
    return len(HELD)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the tables written after a mark, save for the last `but`; frames that read them must not be used any more."""
    for path in HELD[since : len(HELD) - but]:
        files.delete(spark, path)
    del HELD[since : len(HELD) - but]
