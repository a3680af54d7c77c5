import difflib
import random

import pyarrow as pa

from turnstone.operators import keywords as K

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(seed, n, letters):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(n)})


def table(names, at, vectors):
    return pa.table({at: names, vectors: pa.array([[float(x.count(c)) for c in LETTERS] for x in names], pa.list_(pa.float64()))})


def cosine(a, b):
    dot, x, y = (sum(p.count(c) * q.count(c) for c in LETTERS) for p, q in ((a, b), (a, a), (b, b)))
    return dot / (x * y) ** 0.5 if x and y else 0.0


def test_likest_is_that_of_all_pairs_with_few_ratios(monkeypatch):
    """By brute force, with letters that have no vector, words of many kinds of letter and ties; edit ratios are computed for few pairs."""
    ratio, calls = difflib.SequenceMatcher, []
    for most, new, old in ((1, words(1, 150, "abcdeé"), words(2, 300, "abcdeé")), (11, words(3, 80, "жшщюя"), words(4, 200, "жшщюя")), (1, words(5, 60, LETTERS + "éèêçöäüßжшщюя") + ["listen", "aab"], words(6, 200, LETTERS + "éèêçöäüßжшщюя") + ["silent", "tinsel", "ab"])):
        want = {}
        for raw in new:
            s, name = min((-max(round(cosine(raw, x), 9), round(ratio(None, raw, x).ratio(), 9)), x) for x in old)
            if -s >= 0.75:
                want[raw] = (name, -s)
        calls.clear()
        monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a: calls.append(a) or ratio(*a))
        got = K.likest(0.75, True)(table(new, "raw", "v"), table(old, "nearest", "w")).to_pylist()
        monkeypatch.setattr(difflib, "SequenceMatcher", ratio)
        assert {r["raw"]: r["nearest"] for r in got} == {raw: name for raw, (name, _) in want.items()}
        assert all(abs(r["similarity"] - want[r["raw"]][1]) < 1e-9 for r in got)
        assert len(calls) <= most * len(new)
