"""Keyword clouds, lookups and canonical forms."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators.squares import squares, unit_rows

MERGE, FLAG = 0.9, 0.75


def of_projects(keywords: DataFrame, trajectories: DataFrame) -> DataFrame:
    """project, trajectory_id, keyword."""
    return keywords.select("trajectory_id", "keyword").join(trajectories.select("trajectory_id", "project"), "trajectory_id").select("project", "trajectory_id", "keyword")


def cloud(keywords: DataFrame, trajectories: DataFrame) -> DataFrame:
    return of_projects(keywords, trajectories).select("project", "keyword").distinct()


def frequencies(keywords: DataFrame, trajectories: DataFrame) -> DataFrame:
    return of_projects(keywords, trajectories).groupBy("project", "keyword").agg(F.countDistinct("trajectory_id").alias("freq"))


def find(keywords: DataFrame, trajectories: DataFrame, terms: DataFrame, project: str | None = None) -> DataFrame:
    """trajectory_id, project of trajectories with any of the terms (column term); all projects unless one is given."""
    clean = terms.select(T.dedup_key(F.col("term")).alias("keyword")).where("keyword <> ''").distinct()
    chosen = trajectories if project is None else trajectories.where(F.col("project") == project)
    return of_projects(keywords.join(clean, "keyword", "left_semi"), chosen).select("trajectory_id", "project").distinct()


def letter_counts(word: Column) -> Column:
    """A deterministic stand-in for a model: how often each letter from a to z occurs."""
    return F.array(*(F.length(word) - F.length(F.replace(word, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz")).cast("array<double>")


def letter_bits(words: list[str]) -> dict[tuple[str, int], int]:
    """A bit for each letter of words and its first, second, ... time in a word; the 63 most frequent have one of their own, the rest share one."""
    from collections import Counter

    seen = Counter(x for word in words for x in occurrences(word))
    return {x: 1 << min(i, 63) for i, (x, _) in enumerate(sorted(seen.items(), key=lambda kv: (-kv[1], kv[0])))}


def occurrences(word: str) -> set[tuple[str, int]]:
    """A word's letters, each with how often it stood before."""
    seen: dict[str, int] = {}
    out = set()
    for c in word:
        seen[c] = seen.get(c, -1) + 1
        out.add((c, seen[c]))
    return out


def likest(flag: float, edits: bool, block: int = 128) -> Callable:
    """For squares of new (raw, v) and existing words (nearest, w): each new word's likest, the first by name of equals, if it reaches the flag threshold.

    Cosines are taken by products of blocks in single precision, and anew in double for all within its error of the
    highest.  An edit ratio is computed only where it may reach the best found for its new word so far: no ratio is above
    twice the common letters over the two lengths, so what can reach it has a length near the new word's and few differing
    letters.  Those are counted by bits first, which never gives too many."""

    def compare(new, old):
        from difflib import SequenceMatcher

        import numpy as np
        import pyarrow as pa

        out = []
        if new.num_rows and old.num_rows:
            names = sorted(range(old.num_rows), key=old["nearest"].to_pylist().__getitem__)
            old = old.take(pa.array(names))
            words, w = old["nearest"].to_pylist(), unit_rows(old["w"])
            raws, v = new["raw"].to_pylist(), unit_rows(new["v"])
            rough, error = w.astype(np.float32), 4 * w.shape[1] * np.finfo(np.float32).eps
            if edits:
                sizes = np.array([len(x) for x in words])
                by_size = np.argsort(sizes, kind="stable")
                sorted_sizes, letters = sizes[by_size], [occurrences(x) for x in words]
                bit = letter_bits(words)
                bits = np.array([or_of(bit[x] for x in letters[i]) for i in by_size], np.uint64)
            for start in range(0, len(raws), block):
                cosines = v[start : start + block].astype(np.float32) @ rough.T
                for raw, mine, row, top in zip(raws[start : start + block], v[start : start + block], cosines, cosines.max(axis=1)):
                    best, at = 0.0, -1
                    if top >= flag - error:
                        near = np.flatnonzero(row >= top - error)
                        exact = np.round(w[near] @ mine, 9)
                        if exact.max() >= flag:
                            best, at = float(exact.max()), int(near[exact.argmax()])
                    if edits:
                        need, n, held = max(flag, best) - 1e-9, len(raw), occurrences(raw)
                        low, high = np.searchsorted(sorted_sizes, [n * need / (2 - need) - 1e-6, n * (2 - need) / need + 1e-6])
                        apart = np.bitwise_count(bits[low:high] ^ np.uint64(or_of(bit.get(x, 0) for x in held)))
                        most = int((1 - need) * (n + sorted_sizes[high - 1]) + 1e-6) if high > low else 0
                        may = by_size[low + np.flatnonzero(apart <= min(most, 64))].tolist()
                        bounds = [(2 * len(held & letters[i]) / (n + len(words[i])), i) for i in may]
                        for bound, i in sorted((x for x in bounds if x[0] >= need), key=lambda x: (-x[0], x[1])):
                            if bound < max(flag, best) - 1e-9:
                                break
                            alike = max(round(SequenceMatcher(None, raw, words[i]).ratio(), 9), float(np.round(w[i] @ mine, 9)))
                            if alike >= flag and (at < 0 or (-alike, i) < (-best, at)):
                                best, at = alike, i
                    if at >= 0:
                        out.append((raw, words[at], best))
        raw, nearest, similarity = zip(*out) if out else ((), (), ())
        return pa.table({"raw": pa.array(raw, pa.string()), "nearest": pa.array(nearest, pa.string()), "similarity": pa.array(similarity, pa.float64())})

    return compare


def or_of(bits: Iterable[int]) -> int:
    """All bits together."""
    return reduce(int.__or__, bits, 0)


def canonicalize(raw: DataFrame, existing: DataFrame, embed: Callable[[Column], Column] = letter_counts, merge: float = MERGE, flag: float = FLAG, edits: bool = True) -> DataFrame:
    """raw, canonical, nearest, similarity and status (existing, merged, flagged, accepted) of each distinct raw keyword; nearest and similarity only where merged or flagged.

    raw and existing have a column keyword.  Each new keyword is compared with all existing ones, as the merge rule asks,
    in squares of bounded size.  The edit ratio, difflib's with the new word first, is computed only for pairs whose letters
    allow the flag threshold."""
    raw = raw.select("keyword").where("keyword IS NOT NULL AND keyword <> ''").distinct()
    old = existing.select("keyword").where("keyword IS NOT NULL AND keyword <> ''").distinct()
    nothing = [F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("similarity")]
    known = raw.join(old, "keyword", "left_semi").select(F.col("keyword").alias("raw"), F.col("keyword").alias("canonical"), *nothing, F.lit("existing").alias("status"))
    fresh = raw.join(old, "keyword", "left_anti").select(F.col("keyword").alias("raw"))
    word = F.col("keyword")
    near = squares(fresh.select("raw", embed(F.col("raw")).alias("v")), old.select(word.alias("nearest"), embed(word).alias("w")), likest(flag, edits), "raw string, nearest string, similarity double")
    best = near.groupBy("raw").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "nearest")).alias("best"))  # of equals, the first by name
    judged = fresh.join(best, "raw", "left").select("raw", F.col("best.nearest").alias("nearest"), (-F.col("best.s")).alias("similarity"))
    status = F.when(F.col("similarity") >= merge, F.lit("merged")).when(F.col("similarity") >= flag, F.lit("flagged")).otherwise(F.lit("accepted"))
    judged = judged.withColumn("status", status)
    return known.unionByName(judged.withColumn("canonical", F.when(F.col("status") == "merged", F.col("nearest")).otherwise(F.col("raw"))))


def flag_records(mapping: DataFrame, project: str, at: str) -> list[dict]:
    """The flagged keywords of a mapping as records for the log."""
    rows = mapping.where("status = 'flagged'").select("raw", "nearest", F.round("similarity", 4).alias("similarity")).orderBy("raw").collect()
    return [{"timestamp": at, "project": project, "new_keyword": r["raw"], "nearest_existing": r["nearest"], "similarity": r["similarity"]} for r in rows]


def rewrite(keywords: DataFrame, mapping: DataFrame) -> DataFrame:
    """trajectory_id, keyword with canonical keywords, each once."""
    joined = keywords.join(mapping.select(F.col("raw").alias("keyword"), "canonical"), "keyword", "left")
    return joined.select("trajectory_id", F.coalesce("canonical", "keyword").alias("keyword")).distinct()


def top_cloud(frequency: DataFrame, most: int = 40) -> DataFrame:
    """The most frequent keywords of each project."""
    order = Window.partitionBy("project").orderBy(F.desc("freq"), "keyword")
    return frequency.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
