"""Token counts with a whole-token shortcut (operator 2).

The tokenizer splits a normalised text into pre-tokens and merges each of them
on its own.  Offline, each vocabulary string that can end a word is encoded
alone; those that give exactly one token are proven whole.  A pre-token that is
proven whole counts one without any merging; only the rest is merged, each
distinct one once while it stays in a bounded cache.

The shortcut splits texts itself, and does so only where it is certain to split
as the library does: texts of printable ASCII, ASCII white space, Latin-1
letters and common punctuation, after Unicode NFC.  Any other text, and one that
holds a special token's string, goes to the library as it is.

Results on odd input: null texts count as empty (0 bytes, 0 tokens); texts are
taken whole whatever their length; every row gives one row, repeated or not, and
a null doc_id stays null.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from .common import table, worker_cache

LIMIT = 2048
CACHED = 400_000  # distinct merged pre-tokens held by a worker
STEP = 1 << 20  # characters split at a time
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
PLAIN = "[ -~\t-\rÀ-ÖØ-öø-ÿ‐-‧¡«»¿]*"
WORD_END = "</w>"


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """The strings that encode alone as one token, each proven by encoding it.  At most one for each vocabulary entry."""
    tokenizer, letters = load(path), byte_letters()
    found = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith(WORD_END):
            try:
                found.add(bytes(letters[c] for c in entry.removesuffix(WORD_END)).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # no whole string
    splits = re.compile(PIECE)
    strings = sorted(s for s in found if splits.fullmatch(s) and s == s.lower())
    return frozenset(s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole = load(path), dict.fromkeys(whole, 1)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split, self.plain = re.compile(PIECE).findall, re.compile(PLAIN).fullmatch
        self.known = dict(self.whole)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where only the library is certain."""
        if any(s in text for s in self.special):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.split(text.lower()) if self.plain(text) else None

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        split = [self.pieces(t) for t in texts]
        new = list({p for ps in split if ps for p in ps} - self.known.keys())
        if len(self.known) + len(new) > len(self.whole) + CACHED:
            self.known = dict(self.whole)
            new = list({p for ps in split if ps for p in ps} - self.known.keys())
        self.known.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False))))
        one = self.known.__getitem__
        for text, ps in zip(texts, split):
            out.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids) if ps is None else sum(map(one, ps)))
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, by the tokenizer file at path, which every executor must hold."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(whole_tokens(path))  # no larger than the vocabulary

    def count(batches):
        import pyarrow as pa

        cache = worker_cache()
        counter = cache.get(("tokens", path))
        if counter is None:
            counter = cache[("tokens", path)] = Counter(path, held.value)
        for batch in batches:
            texts = batch.column("text")
            sizes, tokens, step, chars = [], [], [], 0
            for value in texts:
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                step.append(text)
                chars += len(text)
                if chars > STEP:
                    tokens += counter.counts(step)
                    step, chars = [], 0
            tokens += counter.counts(step)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, OUT)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
