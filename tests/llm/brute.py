"""Plain versions of the operators, and documents that go wrong easily."""

import hashlib
import math
import random
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ITEM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns that operators use inside themselves; a table may bring its own.
CLASH = "block string, bucket string, slice string, u string, budget string, cut string, before string, first string, node string, component string, fp string, group string, rank string, score string"
N_CLASH = CLASH.count(",") + 1


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(None, None)[: 4 - len(r)], None, *(str(i) for i in range(N_CLASH))) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents(seed=1):
    """Nulls, empty and long texts, ties, repeated rows, shared passages, near copies, accents."""
    rng = random.Random(seed)
    passage, base = text(rng, 60), text(rng, 150)
    near = base.split()
    near[70] = "other"
    rows = [
        (None, "a b c"), (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "x"), (4, "x"), (5, base), (6, base), (7, " ".join(near)), (8, base + " the end"),
        (9, passage + " " + text(rng, 30)), (10, text(rng, 30) + "\n" + passage + "\r\n" + text(rng, 5)), (11, text(rng, 4000)), (11, text(rng, 20)), (12, "Ünï çödé ÀÉ " * 40), (13, "Ünï çödé ÀÉ " * 40 + "z"),
        (14, "same " * 300), (15, "\x0b\x0cA\x00B\x1f é"), (16, "A" * 500), (17, "A" * 90), (18, passage.upper()),
    ]
    return rows + [(20 + i, text(rng, rng.randrange(1, 80))) for i in range(25)]


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def substring(rows, window):
    docs = [WORD.findall((t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, docs):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((key, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def suffix(rows, depth):
    docs = sorted(((k, (t or "").encode()) for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1]).hexdigest()))
    seen, out = set(), []
    for key, raw in docs:
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            if raw[i : i + depth] in seen:
                gone[i : i + depth] = b"\x01" * depth
            seen.add(raw[i : i + depth])
        out.append((key, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(c for c, g in zip(raw, gone) if not g))))
    return out


def items(rows, benchmark, window):
    patterns = {}
    for item, t in benchmark:
        w = ITEM.findall((t or "").encode().lower())
        for i in range(max(1, len(w) - window + 1)) if w and item is not None else ():
            patterns.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes, out = {len(p) for p in patterns}, []
    for key, t in rows:
        w, hit, found = ITEM.findall((t or "").encode().lower()), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if i + n <= len(w) and (p := tuple(w[i : i + n])) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        out.append((key, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode())))
    return out


def roots(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def smallest(keys, of):
    """Each row's component id: the smallest key of its component that isn't None."""
    known = {}
    for k, r in zip(keys, of):
        if k is not None:
            known[r] = min(k, known.get(r, k))
    return [known.get(r) for r in of]


def fingerprint(t, shingle):
    import xxhash

    w = WORD.findall((t or "").encode().lower())
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingles(t, n):
    w = WORD.findall((t or "").encode().lower())
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def context_trees(train, texts, depth, end=255):
    """log10 of each text's probability, node by node."""

    def decisions(t):
        raw = bytes([end]) * depth + (t or "").encode().lower() + bytes([end])
        for i in range(depth, len(raw)):
            for j in range(8):
                yield raw[i - depth : i], 1 << j | (raw[i] >> (8 - j) if j else 0), raw[i] >> (7 - j) & 1

    counts, children = {}, {}
    for t in train:
        for context, node, bit in decisions(t):
            for d in range(depth + 1):
                at = (context[depth - d :], node)
                counts.setdefault(at, [0, 0])[bit] += 1
                if d < depth:
                    children.setdefault(at, set()).add((context[depth - d - 1 :], node))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known = {}

    def weighted(at):
        if at not in known:
            own = kt(*counts[at])
            if len(at[0]) == depth:
                known[at] = own
            else:
                below = sum(weighted(c) for c in children[at])
                top = max(own, below)
                known[at] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        return known[at]

    out = []
    for t in texts:
        total = 0.0
        for context, node, bit in decisions(t):
            p = None
            for d in range(depth, -1, -1):
                at = (context[depth - d :], node)
                a, b = counts.get(at, (0, 0))
                own = (b + 0.5) / (a + b + 1)
                if d == depth:
                    p = own
                else:
                    share = min(1.0, math.exp(kt(a, b) - math.log(2) - (weighted(at) if at in counts else 0.0)))
                    p = share * own + (1 - share) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out
