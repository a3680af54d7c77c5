"""Texts that a model would be asked with, one row each, put together in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators.edus import windows as fact_windows

NO_CLOUD = "(no keywords so far)"
#: Into how many pieces label_digest deals a project's trajectories at most.
PIECES = 24


def ordered(order, line: Column, between: str = "\n") -> Column:
    """The lines of a group, joined in an order."""
    by = F.struct(*order) if isinstance(order, (list, tuple)) else F.col(order)
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), line.alias("line")))), lambda x: x["line"]), between)


def said(style: str = "plain") -> Column:
    turn = F.col("turn_id").cast("string")
    if style == "plain":
        return F.concat(F.lit("[Turn "), turn, F.lit("] "), F.upper("speaker"), F.lit(": "), "text")
    return F.concat(F.lit("#"), turn, F.lit(" <"), "speaker", F.lit("> "), "text")


def turn_prompt(turns: DataFrame) -> DataFrame:
    """session_id, prompt: all turns of a session, a line each, in order."""
    return turns.groupBy("session_id").agg(ordered("turn_id", said()).alias("prompt"))


def chunk_prompt(chunks: DataFrame, turns: DataFrame) -> DataFrame:
    """session_id, chunk, prompt: a chunk's turns between marks that carry a fence (a hash, so that a rerun gives the same), with its range of turns, and a heading wherever core and context meet."""
    at = ["session_id", "chunk"]
    seen = chunks.join(turns.select("session_id", "turn_id", "project", "speaker", "text", "ts"), ["session_id", "turn_id"])
    order = Window.partitionBy(*at).orderBy("turn_id")
    heading = F.when(F.col("is_core"), F.lit("--- core: facts come from these turns only ---\n")).otherwise(F.lit("--- context: read, but take no facts from it ---\n"))
    turned = ~F.lag("is_core").over(order).eqNullSafe(F.col("is_core"))
    mixed = F.min("is_core").over(Window.partitionBy(*at)) != F.max("is_core").over(Window.partitionBy(*at))
    marked = seen.withColumn("line", F.concat(F.when(turned & mixed, heading).otherwise(F.lit("")), said("short")))
    core = F.when(F.col("is_core"), F.col("turn_id"))
    whole = marked.groupBy(*at, "project").agg(
        ordered("turn_id", F.col("line")).alias("body"), F.min("turn_id").alias("a"), F.max("turn_id").alias("b"), F.count("*").alias("n"),
        F.min(core).alias("ca"), F.max(core).alias("cb"), F.count(core).alias("cn"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("day"),
    )
    fence = F.left(F.sha2(F.concat_ws("\x1f", *at, "body"), 256), F.lit(8))
    head = F.format_string("<<< input %s\nProject: %s\nDate: %s\nTurns %d to %d (%d); cite no other.\nCore turns %d to %d (%d).\n", fence, "project", "day", "a", "b", "n", "ca", "cb", "cn")
    return whole.select(*at, F.concat(head, "body", F.format_string("\n>>> end of input %s after turn %d", fence, "b")).alias("prompt"))


def incremental_prompt(known: DataFrame, new_turns: DataFrame) -> DataFrame:
    """session_id, prompt: the facts that are known, then the turns that are new."""
    held = known.groupBy("session_id").agg(ordered("edu_seq", F.concat(F.lit("- ["), "tag", F.lit("] "), "text")).alias("held"))
    fresh = new_turns.groupBy("session_id", "project").agg(ordered("turn_id", said("short")).alias("fresh"))
    both = fresh.join(held, "session_id", "left")
    return both.select("session_id", F.concat(F.lit("Project: "), "project", F.lit("\nKnown facts:\n"), F.coalesce("held", F.lit("(none)")), F.lit("\nNew turns:\n"), "fresh").alias("prompt"))


def boundary_prompt(edus: DataFrame, window: int = 5) -> DataFrame:
    """session_id, edu_seq, prompt: a window's facts with their parts, and what their turns hint at."""
    seen = fact_windows(edus, window)
    shown = F.transform(
        "window",
        lambda f, i: F.concat(
            i.cast("string"), F.when(i == F.col("prev_rel"), F.lit(" previous")).when(i == F.col("prev_rel") + 1, F.lit(" candidate")).otherwise(F.lit(" context")),
            F.lit(" (turns "), F.array_join(f["turns"].cast("array<string>"), ","), F.lit(") ["), f["tag"], F.lit("] "), f["text"],
        ),
    )
    before, after = F.get("window", F.col("prev_rel"))["turns"], F.get("window", F.col("prev_rel") + 1)["turns"]
    gap = F.array_min(after) - F.array_max(before)
    common = F.array_sort(F.array_intersect(before, after))
    hint = F.when(F.size(common) > 0, F.concat(F.lit("both cite turn "), F.array_join(common.cast("array<string>"), ","))).when(gap <= 1, F.lit("their turns are adjacent")).otherwise(F.concat(gap.cast("string"), F.lit(" turns lie between their ends")))
    text = F.concat(F.lit("Facts, oldest first:\n"), F.array_join(shown, "\n"), F.lit("\nHint: "), hint, F.lit("\nIs the candidate about the same topic as the previous one?"))
    return seen.select("session_id", "edu_seq", text.alias("prompt"))


def label_parts(edus: DataFrame, cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each trajectory's facts, numbered (trajectory_id, project, facts), and what the prompts of a project with keywords have before them (project, head)."""
    words = cloud.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ", ").alias("cloud"))
    line = F.concat((F.col("trajectory_index") + 1).cast("string"), F.lit(". ["), "tag", F.lit("] "), "text")
    return edus.groupBy("trajectory_id", "project").agg(ordered("trajectory_index", line).alias("facts")), words.select("project", label_head(F.col("cloud")).alias("head"))


def label_head(cloud: Column) -> Column:
    return F.concat(F.lit("Project: "), "project", F.lit("\nKeywords in use: "), cloud, F.lit("\nFacts:\n"))


def label_prompt(edus: DataFrame, cloud: DataFrame) -> DataFrame:
    """trajectory_id, prompt: a trajectory's facts, numbered, and the keywords its project has."""
    facts, heads = label_parts(edus, cloud)
    return facts.join(heads, "project", "left").select("trajectory_id", F.concat(F.coalesce("head", label_head(F.lit(NO_CLOUD))), "facts").alias("prompt"))


def label_digest(edus: DataFrame, cloud: DataFrame, pieces: int = PIECES) -> DataFrame:
    """trajectory_id, prompt_md5: the MD5 of each of label_prompt's texts, which are not put together for it.

    All prompts of a project begin with its keywords, so together they grow with the square of the input.  Here that
    beginning is hashed once for each of at most `pieces` pieces of a project's trajectories, and each prompt's hash goes on from a copy."""
    facts, heads = label_parts(edus, cloud)
    piece = F.pmod(F.xxhash64("trajectory_id"), F.lit(pieces)).cast("int").alias("_piece")
    held = edus.select("project", piece).distinct().join(heads, "project", "left")
    first = held.select("project", "_piece", F.lit(True).alias("is_head"), F.lit(None).cast(edus.schema["trajectory_id"].dataType).alias("trajectory_id"), F.coalesce("head", label_head(F.lit(NO_CLOUD))).alias("text"))
    rest = facts.select("project", piece, F.lit(False).alias("is_head"), "trajectory_id", F.col("facts").alias("text"))
    rows = first.unionByName(rest).repartition("project", "_piece").sortWithinPartitions("project", "_piece", F.desc("is_head"))

    def digest(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        begun = None  # of the piece that is being read; its head comes first
        for batch in batches:
            sums = []
            for head, text in zip(batch["is_head"].to_pylist(), batch["text"]):
                if head:
                    begun = hashlib.md5(text.as_py().encode(), usedforsecurity=False) if text.is_valid else None
                    continue
                if begun is not None:
                    whole = begun.copy()
                    whole.update(text.as_py().encode())
                sums.append(None if begun is None else whole.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["trajectory_id"].filter(pc.invert(batch["is_head"])), pa.array(sums, pa.string())], ["trajectory_id", "prompt_md5"])

    return rows.select("is_head", "trajectory_id", "text").mapInArrow(digest, f"trajectory_id {edus.schema['trajectory_id'].dataType.simpleString()}, prompt_md5 string")
