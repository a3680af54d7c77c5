"""Facts (EDUs) from turns, their segmentation into trajectories, and trajectory keywords.

Four steps can be a model's: extraction, boundaries, labels and (in catalog) the
curator.  Each has a deterministic default made of column expressions, and a hook
that runs a Python function over Arrow batches, with the same fallback on error
that a model's failure has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import turns as N

BOUNDARY_WINDOW = 5
SAME_TOPIC = 0.05
SUMMARY_CHARS = 120
KEYWORDS = 3
NO_KEYWORDS = "uncategorized"
RAW = "chunk long, pos long, text string, source_turn_ids array<string>, tag string, failed boolean, limited boolean"


class RateLimited(Exception):
    """Raised by a hook when its service takes no more work; the worker then asks no more, and what it skips stays pending."""


def kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


# extraction


def line_facts(turns: DataFrame) -> DataFrame:
    """The default extractor: a fact for each line that isn't blank; pos says where it stood in its turn, which it cites."""
    speaker = F.array("speaker") if "speaker" in turns.columns else F.array().cast("array<string>")
    lines = turns.select("session_id", "project", "turn_id", "ts", speaker.alias("speakers"), F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line"))
    kept = lines.withColumn("text", T.strip(F.col("line"))).where("text <> ''")
    return kept.select("session_id", "project", "ts", "turn_id", F.col("pos").cast("long").alias("pos"), "text", F.array("turn_id").alias("source_turn_ids"), "speakers")


def extract_with(turns: DataFrame, extractor: Callable[[list[dict], set[int]], list[dict]], core: int = N.CORE, margin: int = N.MARGIN, concurrency: int | None = None) -> DataFrame:
    """Raw facts by a model, with session_id and the columns of RAW.

    extractor gets a chunk's turns in order (dicts of turn_id, speaker, text, ts) and the ids of its core, and gives dicts
    of text, source_turn_ids and tag.  A chunk whose call fails gives one row with failed set.  concurrency: the most
    calls at a time."""
    chunked = N.chunks(turns, core, margin).join(turns.select("session_id", "turn_id", "speaker", "text", "ts"), ["session_id", "turn_id"])
    chunked = chunked if concurrency is None else chunked.repartition(concurrency, "session_id", "chunk")
    stopped = {"limited": False}  # of this worker's task

    def run(key, rows):
        import pandas as pd

        rows = rows.sort_values("turn_id")
        out = []
        try:
            if stopped["limited"]:
                raise RateLimited
            found = extractor(rows[["turn_id", "speaker", "text", "ts"]].to_dict("records"), {int(t) for t in rows.turn_id[rows.is_core]})
            for i, f in enumerate(found or []):
                out.append((key[0], key[1], i, str(f.get("text") or ""), [str(x) for x in f.get("source_turn_ids") or [] if isinstance(x, (int, float))], f.get("tag"), False, False))
        except Exception as e:
            stopped["limited"] |= isinstance(e, RateLimited)
            out = [(key[0], key[1], -1, None, None, None, True, stopped["limited"])]
        return pd.DataFrame(out, columns=["session_id", "chunk", "pos", "text", "source_turn_ids", "tag", "failed", "limited"])

    return chunked.groupBy("session_id", "chunk").applyInPandas(run, f"session_id {kind(turns, 'session_id')}, {RAW}")


def clip_citations(facts: DataFrame, low: Column, high: Column) -> DataFrame:
    """Facts with cited turns (source_turn_ids) in [low, high) only; those without any left are dropped."""
    kept = facts.withColumn("source_turn_ids", F.filter("source_turn_ids", lambda i: (i >= low) & (i < high)))
    return kept.where(F.size("source_turn_ids") > 0)


def clip_to_core(facts: DataFrame, core: int = N.CORE) -> DataFrame:
    """Facts with citations of their own chunk's core only."""
    return clip_citations(facts, F.col("chunk") * core, (F.col("chunk") + 1) * core)


def cited(raw: DataFrame, turns: DataFrame, core: int = N.CORE) -> DataFrame:
    """Raw facts as facts: citations coerced and clipped to the chunk's core and to turns there are; ts is that of the first one cited, speakers are all, turn_id is the smallest."""
    some = raw.where(~F.col("failed")).withColumn("text", T.strip(F.col("text"))).where("text <> ''").withColumn("tag", T.coerce_tag(F.col("tag")))
    some = clip_to_core(some.withColumn("source_turn_ids", T.whole_numbers(F.col("source_turn_ids"))), core)
    each = some.select("session_id", "chunk", "pos", "text", "tag", F.posexplode("source_turn_ids").alias("at", "turn_id"))
    met = each.join(turns.select("session_id", "turn_id", "project", "ts", "speaker"), ["session_id", "turn_id"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "turn_id"))), lambda x: x["turn_id"])
    return met.groupBy("session_id", "chunk", "pos", "text", "tag").agg(
        F.min_by("project", "at").alias("project"), F.min_by("ts", "at").alias("ts"), F.min("turn_id").alias("turn_id"), ids.alias("source_turn_ids"), F.array_sort(F.collect_set("speaker")).alias("speakers"),
    )


def dedup_facts(facts: DataFrame, known: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """The first of equal facts (by trimmed lower case) of a session, with edu_id from session, turn and text, and edu_seq in order of the smallest cited turn.

    Which is first goes by chunk, if there are chunks, then turn and place.  known: facts (session_id, text) of earlier
    passes, which are not taken again.  start: session_id and edu_count, where edu_seq goes on."""
    place = [c for c in ("chunk", "turn_id", "pos") if c in facts.columns]
    first = Window.partitionBy("session_id", T.dedup_key(F.col("text"))).orderBy(*place)
    kept = facts.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    if known is not None:
        seen = known.select("session_id", T.dedup_key(F.col("text")).alias("_key")).distinct()
        kept = kept.withColumn("_key", T.dedup_key(F.col("text"))).join(seen, ["session_id", "_key"], "left_anti").drop("_key")
    order = ["turn_id", *(c for c in place if c != "turn_id")]
    kept = kept.withColumn("edu_seq", (F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1).cast("long"))
    if start is not None:
        kept = kept.join(start.select("session_id", F.col("edu_count").alias("_from")), "session_id", "left").withColumn("edu_seq", F.col("edu_seq") + F.coalesce("_from", F.lit(0))).drop("_from")
    return kept.withColumn("edu_id", F.sha2(F.concat_ws("\x1f", "session_id", "turn_id", "text"), 256))


# boundaries


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def boundaries(edus: DataFrame, threshold: float = SAME_TOPIC, window: int = BOUNDARY_WINDOW) -> DataFrame:
    """edus with the fact before (prev_turn, shared turns, gap, hint, similarity), whether it is of the same topic (null for a session's first), and the window a classifier would see."""
    order = Window.partitionBy("session_id").orderBy("edu_seq")
    back, ahead = around(window)
    size, place = F.count("*").over(Window.partitionBy("session_id")), F.row_number().over(order) - 1
    before = F.lag("source_turn_ids").over(order)
    edus = edus.withColumn("_toks", F.array_distinct(T.tokens(F.col("text"))))
    marked = edus.withColumns({"_prev": before, "prev_text": F.lag("text").over(order), "_prev_toks": F.lag("_toks").over(order), "n": size, "_at": place.cast("long")}).withColumn("prev_turn", F.array_max("_prev"))
    shared = F.array_sort(F.array_intersect("_prev", "source_turn_ids"))
    gap = F.array_min("source_turn_ids") - F.col("prev_turn")
    hint = F.when(F.size(shared) > 0, F.lit("shared")).when(gap <= 1, F.lit("adjacent")).otherwise(F.concat(gap.cast("string"), F.lit(" apart")))
    alike = jaccard(F.col("_prev_toks"), F.col("_toks"))
    low = F.greatest(F.lit(0), F.col("_at") - 1 - back)
    found = marked.withColumns({"gap": gap, "shared_turns": shared, "similarity": alike, "hint": hint})
    found = found.withColumns({"window_start": low.cast("long"), "window_end": F.least(F.col("n"), F.col("_at") + 1 + ahead).cast("long")})
    found = found.withColumn("prev_rel", F.col("_at") - 1 - F.col("window_start")).drop("_prev", "_at", "_toks", "_prev_toks")
    near = (F.size("shared_turns") > 0) | (F.col("gap") <= 1)
    return found.withColumn("same", F.when(F.col("prev_turn").isNull(), F.lit(None)).otherwise(near & (F.col("similarity") >= threshold)))


def around(window: int) -> tuple[int, int]:
    """How many facts of a window stand before the previous and after the candidate."""
    extras = max(0, window - 2)
    return extras // 2, extras - extras // 2


def windows(edus: DataFrame, window: int = BOUNDARY_WINDOW) -> DataFrame:
    """session_id, edu_seq, prev_rel and window, the facts (turns, tag, text) that a classifier sees, for each fact but a session's first."""
    back, ahead = around(window)
    order = Window.partitionBy("session_id").orderBy("edu_seq")
    tag = F.col("tag") if "tag" in edus.columns else F.lit(T.DEFAULT_TAG)
    seen = F.collect_list(F.struct(F.col("source_turn_ids").alias("turns"), tag.alias("tag"), "text")).over(order.rowsBetween(-1 - back, ahead))
    rel = F.least(F.row_number().over(order) - 2, F.lit(back)).cast("long")
    return edus.select("session_id", "edu_seq", seen.alias("window"), rel.alias("prev_rel")).where("prev_rel >= 0")


def classify_with(edus: DataFrame, classifier: Callable[[list[dict], int], bool], window: int = BOUNDARY_WINDOW, concurrency: int | None = None) -> DataFrame:
    """edus with same by a model, which gets a window's facts and the place of the previous one (the candidate is next); failures and answers other than true or false count as the same topic."""
    seen = windows(edus, window)
    seen = seen if concurrency is None else seen.repartition(concurrency, "session_id", "edu_seq")

    def run(batches):
        for rows in batches:
            same = []
            for w, rel in zip(rows.window, rows.prev_rel):
                try:
                    answer = classifier([dict(x.items() if hasattr(x, "items") else x.asDict()) for x in w], int(rel))
                except Exception:
                    answer = True
                same.append(answer if isinstance(answer, bool) else True)
            yield rows[["session_id", "edu_seq"]].assign(same=same)

    judged = seen.mapInPandas(run, f"session_id {kind(edus, 'session_id')}, edu_seq long, same boolean")
    return edus.join(judged, ["session_id", "edu_seq"], "left")


def segment(judged: DataFrame) -> DataFrame:
    """edus with `same` get grp, trajectory_id (from the segment's first fact) and trajectory_index; a missing decision means the same topic."""
    order = Window.partitionBy("session_id").orderBy("edu_seq")
    breaks = F.when(F.coalesce("same", F.lit(True)), F.lit(0)).otherwise(F.lit(1))
    grouped = judged.withColumn("grp", F.sum(breaks).over(order).cast("long"))
    inside = Window.partitionBy("session_id", "grp").orderBy("edu_seq")
    named = F.sha2(F.concat_ws("\x1f", F.lit("trajectory"), "session_id", F.first("edu_id").over(inside)), 256)
    return grouped.withColumns({"trajectory_id": named, "trajectory_index": (F.row_number().over(inside) - 1).cast("long")})


# trajectories


def trajectories(edus: DataFrame) -> DataFrame:
    """One row a segment: the turns it cites, earliest time, first text as summary and number of facts."""
    summary = F.coalesce(F.min_by(F.left("text", F.lit(SUMMARY_CHARS)), "edu_seq"), F.lit("(unlabeled)"))  # cut before it is shuffled
    return edus.groupBy("trajectory_id", "session_id", "project").agg(
        F.min(F.array_min("source_turn_ids")).alias("start_turn"), F.max(F.array_max("source_turn_ids")).alias("end_turn"), F.min("ts").alias("created_at"), summary.alias("summary"), F.count("*").alias("edu_count"),
    )


def trajectory_keywords(edus: DataFrame, top: int = KEYWORDS) -> DataFrame:
    """trajectory_id, keyword: the most frequent words of four letters at least; one placeholder where there are none.

    The texts are shuffled once, before they become words with an id each."""
    words = edus.select("trajectory_id", "text").repartition("trajectory_id").select("trajectory_id", F.explode_outer(T.keyword_tokens(F.col("text"))).alias("keyword"))
    counted = words.groupBy("trajectory_id", "keyword").agg(F.count("*").alias("n"))
    best = Window.partitionBy("trajectory_id").orderBy(F.col("keyword").isNull(), F.desc("n"), "keyword")
    kept = counted.withColumn("rn", F.row_number().over(best)).where((F.col("rn") <= top) & (F.col("keyword").isNotNull() | (F.col("rn") == 1)))
    return kept.select("trajectory_id", F.coalesce("keyword", F.lit(NO_KEYWORDS)).alias("keyword"))


def label_with(edus: DataFrame, labeller: Callable[[str, list[dict], list[str]], tuple[str, list[str]]], cloud: DataFrame | None = None, concurrency: int | None = None) -> DataFrame:
    """trajectory_id, summary and keywords (clean, in order) by a model, which gets the project, the facts in order and the project's keyword cloud.

    A call that fails, and one without any keyword left, gives placeholders, as the labels' contract has them."""
    held = edus.select("trajectory_id", "project", "edu_seq", F.col("tag") if "tag" in edus.columns else F.lit(T.DEFAULT_TAG).alias("tag"), "text")
    if cloud is not None:
        lists = cloud.groupBy("project").agg(F.array_sort(F.collect_set("keyword")).alias("cloud"))
        held = held.join(lists, "project", "left")
    else:
        held = held.withColumn("cloud", F.array().cast("array<string>"))
    held = held if concurrency is None else held.repartition(concurrency, "trajectory_id")

    def run(key, rows):
        import pandas as pd

        rows = rows.sort_values("edu_seq")
        try:
            first = rows.cloud.iloc[0]
            summary, words = labeller(rows.project.iloc[0], rows[["tag", "text"]].to_dict("records"), [] if first is None else list(first))
            summary, words = str(summary).strip(), [w for w in words if isinstance(w, str)]
        except Exception:
            summary, words = "", []
        return pd.DataFrame([(key[0], summary or f"(unlabeled trajectory of {len(rows)} EDUs)", words)], columns=["trajectory_id", "summary", "keywords"])

    said = held.groupBy("trajectory_id").applyInPandas(run, "trajectory_id string, summary string, keywords array<string>")
    clean = T.clean_keywords(F.col("keywords"))
    return said.withColumn("keywords", F.when(F.size(clean) > 0, clean).otherwise(F.array(F.lit(NO_KEYWORDS))))


def labelled(paths: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trajectories and trajectory keywords with a labeller's summaries and keywords."""
    named = paths.drop("summary").join(labels.select("trajectory_id", "summary"), "trajectory_id").select(*paths.columns)
    return named, labels.select("trajectory_id", F.explode("keywords").alias("keyword")).distinct()

