"""Quality classifier by a linear-chain conditional random field (operator 5).

Every line of a document is labelled good or bad.  A line's features are its own
statistics and those of the line before and after; a transition weight
ties neighbouring labels.  Forward and backward passes give each line's marginal
probability of being good, and the mean of the marginals, weighted by the lines'
lengths, calibrated by a logistic curve, is the document's score.

Only documents are labelled, so in training each line has its document's label.
The model is fitted on the driver, on at most SAMPLE documents of each label (the
first ones in order of a hash of doc_id) of at most SAMPLE_BYTES bytes and
SAMPLE_LINES lines.  These bounds concern the fit alone: every whole text is
scored.  doc_id, lang, source and labels are never features.

Results on odd input: a null or empty text has no lines and scores the share of
good documents in the sample; labels that are null, or whose document isn't
there, teach nothing; with labels of one kind only (or none) every text scores
that share, or 0.5 without any; a null doc_id counts as held out; rows that
repeat a doc_id are scored one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .common import buffer, table

SAMPLE = 1500
SAMPLE_BYTES = 20_000
SAMPLE_LINES = 100
STEP = 1 << 19  # bytes of text whose features are held at a time: some 80 bytes of arrays for each
ROUNDS = 150
TIE = 0.5  # labels of whole documents can't teach it: in them all neighbours are alike
THRESHOLD = 0.3
FOLDS = 5


def classes() -> tuple[np.ndarray, int]:
    """A class for each byte: letters by case, digits, white space, beyond ASCII, control, and each punctuation mark its own."""
    kind, n = np.zeros(256, np.int64), 6
    for c in range(256):
        if c > 127:
            kind[c] = 4
        elif chr(c).isupper():
            kind[c] = 0
        elif chr(c).islower():
            kind[c] = 1
        elif chr(c).isdigit():
            kind[c] = 2
        elif chr(c).isspace():
            kind[c] = 3
        elif c < 32 or c == 127:
            kind[c] = 5
        else:
            kind[c], n = n, n + 1
    return kind, n


KIND, KINDS = classes()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
OWN = KINDS + 8
WIDTH = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray):
    """Features of all lines with a word in them, each line's length in bytes, and where each document's lines begin among them."""
    n = len(data)
    if not n:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(len(offsets), np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    first[1:] |= data[:-1] == 10
    starts = np.flatnonzero(first)
    lengths = np.diff(np.concatenate([starts, [n]]))
    line = np.repeat(np.arange(len(starts)), lengths)
    counts = np.bincount(line * KINDS + KIND[data], minlength=len(starts) * KINDS).reshape(-1, KINDS)
    word = ~SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:]
    end[:-1] &= ~word[1:] | first[1:]
    ws, we = np.flatnonzero(begin), np.flatnonzero(end) + 1
    roll = X.Rolling(X.mix(np.arange(1, 257, dtype=np.uint64))[data])
    hashed, of = (roll.sums[we] - roll.sums[ws]) * roll.back[ws], line[ws]
    words = np.bincount(of, minlength=len(starts))
    own = np.zeros((len(starts), OWN), np.float32)
    own[:, :KINDS] = np.sqrt(counts / lengths[:, None])
    own[:, KINDS] = np.log1p(lengths) / 5
    own[:, KINDS + 1] = np.log1p(words) / 4
    own[:, KINDS + 2] = np.log1p(lengths / np.maximum(words, 1)) / 2
    for lag in (1, 2, 3):
        same = (hashed[lag:] == hashed[:-lag]) & (of[lag:] == of[:-lag])
        own[:, KINDS + 2 + lag] = np.bincount(of[lag:][same], minlength=len(starts)) / np.maximum(words, 1)
    own[:, KINDS + 6] = counts[:, 6:].sum(1) / lengths
    own[:, KINDS + 7] = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    full = words > 0
    own, lengths, starts = own[full], lengths[full], starts[full]
    bounds = np.searchsorted(starts, offsets)
    features = np.zeros((len(own), WIDTH), np.float32)
    features[:, :OWN] = own
    inner = np.ones(len(own), bool)
    inner[bounds[:-1][bounds[:-1] < len(own)]] = False  # lines with one before them in their document
    if len(own) > 1:
        features[1:, OWN : 2 * OWN] = own[:-1] * inner[1:, None]
        features[:-1, 2 * OWN : 3 * OWN] = own[1:] * inner[1:, None]
    features[:, -1] = 1
    return features, lengths.astype(float), bounds


class Model:
    """odds = features @ weight is a line's log-odds of being good; tie is added to each pair of like neighbours."""

    def __init__(self, weight, tie: float, slope: float, shift: float, prior: float):
        self.weight, self.tie, self.slope, self.shift, self.prior = weight, tie, slope, shift, prior

    def raw(self, data, offsets) -> np.ndarray:
        """The length-weighted mean marginal of each document; nan without lines."""
        features, lengths, bounds = line_features(data, offsets)
        odds = marginals((features @ self.weight).astype(float), walk(bounds), self.tie)
        good = lengths / (1 + np.exp(-np.clip(odds, -30, 30)))
        total, weight = (np.concatenate([[0], np.cumsum(v)])[bounds] for v in (good, lengths))
        with np.errstate(invalid="ignore"):
            return np.diff(total) / np.diff(weight)

    def scores(self, data, offsets) -> np.ndarray:
        m = self.raw(data, offsets)
        known = ~np.isnan(m)
        m = np.clip(np.where(known, m, 0.5), 1e-6, 1 - 1e-6)
        return np.where(known, 1 / (1 + np.exp(-(self.slope * np.log(m / (1 - m)) + self.shift))), self.prior)


def walk(bounds: np.ndarray) -> list[np.ndarray]:
    """For each t, the t-th lines of all documents that have one."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    heads, left = bounds[:-1][order], -n[order]
    return [heads[: int(np.searchsorted(left, -t))] + t for t in range(int(n.max()) if len(n) else 0)]


def marginals(odds: np.ndarray, steps: list[np.ndarray], tie: float) -> np.ndarray:
    """Each line's log-odds of being good given all lines of its document, by forward and backward passes, all documents at once."""
    odds, e = np.clip(odds, -30, 30), np.exp(tie)

    def passed(odds):  # what a line tells its neighbour over the tie
        g = np.exp(np.clip(odds, -30, 30))
        return np.log((g * e + 1) / (g + e))

    ahead, back = np.zeros(len(odds)), np.zeros(len(odds))
    for now in steps[1:]:
        ahead[now] = passed(odds[now - 1] + ahead[now - 1])
    for now in reversed(steps[1:]):
        back[now - 1] = passed(odds[now] + back[now])
    return odds + ahead + back


def fit(texts: list[str], good: np.ndarray, share: float, rounds: int = ROUNDS, tie: float = TIE) -> Model:
    """share: of good documents among all; the sample may hold another."""
    import pyarrow as pa

    if not len(texts) or good.all() or not good.any():
        prior = float(np.clip(share, 0.01, 0.99)) if len(texts) else 0.5
        return Model(np.zeros(WIDTH, np.float32), 0.0, 0.0, float(np.log(prior / (1 - prior))), prior)
    data, offsets = buffer(pa.array(texts, pa.string()))
    x, lengths, bounds = line_features(data, offsets)
    n_lines = np.diff(bounds)
    y = np.repeat(good, n_lines).astype(float)
    importance = np.where(good, share / good.mean(), (1 - share) / (1 - good.mean()))
    each = np.repeat(importance / np.maximum(n_lines, 1), n_lines)
    steps = walk(bounds)
    w, m, v = (np.zeros(WIDTH) for _ in range(3))
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(marginals(x @ w, steps, tie), -30, 30)))
        g = x.T @ ((p - y) * each) / len(texts) + 1e-4 * w  # expected less observed features
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w = w - 0.15 * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = Model(w.astype(np.float32), tie, 1.0, 0.0, share)
    raw = np.nan_to_num(model.raw(data, offsets), nan=0.5)
    z = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1))
    a, b = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d = (p - good) * importance
        a, b = max(0.05, a - 0.5 * float(np.mean(d * z) + 0.001 * (a - 1))), b - 0.5 * float(np.mean(d))
    model.slope, model.shift = a, b
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = {r["doc_id"]: r["quality"] for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not picked:
        return fit([], np.zeros(0, bool), 0.5)
    rows = docs.where(F.col("doc_id").isin(list(picked)) & (F.octet_length("text") <= SAMPLE_BYTES) & (F.size(F.split("text", "\n")) <= SAMPLE_LINES)).select("doc_id", "text").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], np.array([picked[r["doc_id"]] == 1 for r in rows], bool), counts.get(1, 0) / sum(counts.values()))


def score_column(model: Model):
    """An expression's maker: the score of a text column, whole batches at a time."""

    @F.arrow_udf("double")
    def scores(text):
        import pyarrow as pa

        data, offsets = buffer(text)
        found, at = [np.zeros(0)], 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, side="right")) - 1)
            found.append(model.scores(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            at = to
        return pa.array(np.concatenate(found))

    return scores


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold at least; all columns go through as they are."""
    return docs.where(score_column(model)(F.col("text")) >= threshold)


def fold(folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(FOLDS) != 0))
    scored = docs.select("doc_id", (fold(FOLDS) == 0).alias("held_out"), score_column(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
