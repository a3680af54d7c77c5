"""Session logs: one JSON object a line, at <root>/<project>/<session>.jsonl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators.turns import number_turns

TAIL = 128
NAME = r"([^/]+)/([^/]+)\.jsonl$"


def content_text(content: Column) -> Column:
    """A message's text: the string itself, or its text blocks, a line each; empty for anything else."""
    blocks = F.expr("try_variant_get(content, '$', 'array<variant>')")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    whole = F.when(F.expr("schema_of_variant(content)") == "STRING", F.expr("try_variant_get(content, '$', 'string')"))
    return T.strip(F.coalesce(whole, F.array_join(texts, "\n"), F.lit("")))


def named(path: Column) -> tuple[Column, Column]:
    """session_id and raw_project of a file's path."""
    return F.regexp_extract(path, NAME, 2), F.regexp_extract(path, NAME, 1)


def decoded(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, uri, session_id, project, size and modified of every file one folder below root, in order; nothing is read."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*.jsonl").select("path", F.col("_metadata.file_path").alias("uri"), "length", "modificationTime")
    session, raw = named(F.col("path"))
    return files.select("path", "uri", session.alias("session_id"), T.clean_project(raw).alias("project"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def signatures(spark: SparkSession, root: str) -> DataFrame:
    """session_id, project, hash (size and MD5 of the last bytes), modified and path of every file; only those bytes are read."""

    def tails(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            ends = []
            for uri, size in zip(batch.column("uri").to_pylist(), batch.column("size").to_pylist()):
                system, inner = fs.FileSystem.from_uri(uri)
                with system.open_input_file(inner) as f:
                    f.seek(max(0, size - TAIL))
                    ends.append(f.read(TAIL))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.binary())], names=[*batch.schema.names, "tail"])

    found = discover(spark, root).mapInArrow(tails, "path string, uri string, session_id string, project string, size long, modified timestamp, tail binary")
    return found.select("session_id", "project", F.concat_ws(":", "size", F.md5("tail")).alias("hash"), "modified", "path")


def read_lines(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """session_id, raw_project, line_no and line of every file, or of the paths given.

    line_no is where a line stands in its file: the start of its piece, and the order within it.  Large files are
    read in pieces."""
    files = spark.read.text(paths if paths is not None else f"{root}/*/*.jsonl")
    session, raw = named(decoded(F.col("_metadata.file_path")))
    place = F.struct(F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"))
    return files.select(session.alias("session_id"), raw.alias("raw_project"), place.alias("line_no"), F.col("value").alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Turns of read_lines: lines that are blank, no JSON, of other types, or without text or time are dropped."""
    parsed = lines.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL")
    fields = parsed.select(
        "session_id", T.clean_project(F.col("raw_project")).alias("project"), "line_no", F.try_variant_get("v", "$.type", "string").alias("speaker"),
        F.try_variant_get("v", "$.message.content", "variant").alias("content"), F.try_to_timestamp(F.try_variant_get("v", "$.timestamp", "string")).alias("ts"), F.try_variant_get("v", "$.gitBranch", "string").alias("git_branch"),
    )
    texts = fields.where("ts IS NOT NULL AND content IS NOT NULL").withColumn("text", content_text(F.col("content"))).drop("content")
    return number_turns(texts, "line_no").select("session_id", "project", "turn_id", "ts", "speaker", "text", "git_branch")


def read_turns(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    return parse_lines(read_lines(spark, root, paths))


def bad_lines(lines: DataFrame) -> DataFrame:
    """session_id, lines and bad: how many lines a file has, and how many that aren't blank are no JSON."""
    bad = (F.trim("line") != "") & F.try_parse_json("line").isNull()
    return lines.groupBy("session_id").agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad"))
