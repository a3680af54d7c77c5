"""Benchmark decontamination by one Aho-Corasick automaton (operator 9).

The windows of all benchmark items (questions and answers alike), normalised to
lower-case words with one space around each, are the patterns of one automaton.
Each document is normalised the same way and scanned once; where it matches,
word numbers lead back to byte offsets in the original text.

The automaton goes to every executor.  Patterns of more than PATTERN_BYTES are
cut, whole items at a time, into several automata, each of that size or one item
at most.  A text is scanned by each of them, one automaton at a time in a worker,
and the hits of all are put together.

Results on odd input: null texts have no words, in documents and items; an item
without words matches nothing; items with a null item_id are left out; items of
equal texts all count; rows that repeat a doc_id are documents of their own.
Empty tables give empty results, or documents without hits.  Texts are taken
whole.  Columns besides doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_cache

WINDOW = 8
MIN_ITEMS = 2
PATTERN_BYTES = 8 << 20  # of an automaton, a megabyte of item texts or so; a worker takes up to some 80 bytes for each
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "spans array<struct<start: int, end: int>>"
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(words: list[bytes], window: int) -> list[bytes]:
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


class Scanner:
    def __init__(self, patterns: dict[bytes, tuple[int, ...]], names: list[str]):
        import ahocorasick

        self.names, self.automaton = names, ahocorasick.Automaton()
        for pattern, items in patterns.items():
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, items))
        if patterns:
            self.automaton.make_automaton()

    def find(self, text: str | None):
        """Where windows end (word numbers, one past), their words, and the items found."""
        words = normal_words(text)
        if not words or not len(self.automaton):
            return [], [], []
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return [], [], []
        closing = np.cumsum([1 + len(w) for w in words])  # where each word's last space stands
        ends = np.searchsorted(closing, [end for end, _ in found]) + 1
        return ends.tolist(), [n for _, (n, _) in found], sorted({self.names[i] for _, (_, these) in found for i in these})


def spans_of(text: str | None, ends: list[int], sizes: list[int]):
    """Number of words, number of hit words, byte spans of hit runs in the text."""
    clean = (text or "").encode().translate(NORMAL)
    letters = np.frombuffer(clean, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], letters.view(np.int8), [0]])))
    n = len(edges) // 2
    if not ends:
        return n, 0, []
    change, last = np.zeros(n + 1, np.int64), np.array(ends)
    np.add.at(change, last - np.array(sizes), 1)
    np.add.at(change, last, -1)
    hit = np.cumsum(change[:-1]) > 0
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return n, int(hit.sum()), [{"start": int(edges[2 * a]), "end": int(edges[2 * b - 1])} for a, b in zip(runs[::2], runs[1::2])]


def find_benchmarks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The columns of OUT for each document, item_ids (sorted as strings) and spans, byte ranges of the original text."""
    scanners = automata(docs, benchmark, window, pattern_bytes)

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scanned(texts, scanners)
            rows = [(*spans_of(t, ends, sizes), sorted(items)) for t, (ends, sizes, items) in zip(texts, found)]
            columns = {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "n_hit": pa.array([r[1] for r in rows], pa.int64()),
                "n_items": pa.array([len(r[3]) for r in rows], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(r[3]).encode()).hexdigest() for r in rows], pa.string()),
                "contaminated": pa.array([len(r[3]) >= min_items for r in rows], pa.bool_()),
                "item_ids": pa.array([r[3] for r in rows], pa.list_(pa.string())),
                "spans": pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select("doc_id", "text").mapInArrow(search, f"{OUT}, item_ids array<string>, {SPANS}")


def scanned(texts: list, scanners) -> list:
    """Ends, sizes and item names found in each text by all automata, one after the other."""
    out = [([], [], set()) for _ in texts]
    for i in range(len(scanners)):
        scanner = scanners.get(i)
        for (ends, sizes, items), text in zip(out, texts):
            e, n, names = scanner.find(text)
            ends += e
            sizes += n
            items.update(names)
    return out


class Automata:
    """Bounded automata by number; a worker builds one when it needs it, and keeps the last."""

    def __init__(self, parts: list, keys: list[str]):
        self.parts, self.keys = parts, keys

    def __len__(self) -> int:
        return len(self.parts)

    def get(self, i: int) -> Scanner:
        cache = worker_cache()
        if cache.get("decontam", (None,))[0] != self.keys[i]:
            cache["decontam"] = (self.keys[i], Scanner(*self.parts[i].value))
        return cache["decontam"][1]


def automata(docs: DataFrame, benchmark: DataFrame, window: int, pattern_bytes: int) -> Automata:
    """The benchmark's windows as automata of bounded size.  The items pass the driver one by one; it holds one automaton's patterns at a time."""
    context, parts, keys = docs.sparkSession.sparkContext, [], []
    patterns: dict[bytes, set[int]] = {}
    names: list[str] = []
    size = 0

    def close():
        nonlocal patterns, names, size
        frozen = {p: tuple(sorted(i)) for p, i in sorted(patterns.items())}
        keys.append(hashlib.sha256(repr((names, frozen)).encode()).hexdigest())
        parts.append(context.broadcast((frozen, names)))
        patterns, names, size = {}, [], 0

    for r in named(benchmark).orderBy("item_id").toLocalIterator():
        found = windows(normal_words(r["text"]), window)
        more = sum(map(len, found))
        if names and size + more > pattern_bytes:
            close()
        names.append(r["item_id"])
        size += more
        for w in found:
            patterns.setdefault(w, set()).add(len(names) - 1)
    if names:
        close()
    return Automata(parts, keys)


def named(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The rows of docs with windows of fewer than min_items items; all columns go through as they are."""
    scanners = automata(docs, benchmark, window, pattern_bytes)

    @F.arrow_udf("int")
    def items(text):
        import pyarrow as pa

        return pa.array([len(found[2]) for found in scanned(text.to_pylist(), scanners)], pa.int32())

    return docs.where(items(F.col("text")) < min_items)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmarks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "spans")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 8) AS n FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM s)),
z AS (SELECT DISTINCT n FROM p),
x AS (SELECT rid, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN z ON len(ws) >= n)),
h AS (SELECT rid, i, x.n, item_id FROM x JOIN p ON x.w = p.w AND x.n = p.n),
j AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
g AS (SELECT rid, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS t FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(j.n, 0)::BIGINT AS n_hit, coalesce(g.n, 0)::BIGINT AS n_items, sha256(coalesce(g.ids, '')) AS items_sha256, coalesce(g.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN j USING (rid) LEFT JOIN g USING (rid)
"""
