"""Periodic runs against brute force."""

import hashlib
import random

import numpy as np
import pytest

from hearthgrid.llm.periodic import SuffixTree, maximal_runs, periodic_runs, planted, repeating_stretches

from .helpers import corpus, frame


def all_runs(w, least, power):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found[i, j - i + q] = min(found.get((i, j - i + q), q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def row_of(i, text, change=None):
    w = (text or "").encode().split()
    at = change(i, len(w)) if change else None
    w = w if at is None else [w[k] for k in at]
    runs = all_runs(w, 24, 3)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), b" ".join(x for k, x in enumerate(w) if k not in gone))


def test_runs_of_short_sequences():
    rng = random.Random(5)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(40))]
        for least, power in ((1, 2), (1, 3), (6, 3)):
            assert maximal_runs(np.array(w, dtype=int), least, power) == all_runs(w, least, power)


def test_common_extensions():
    w = np.random.default_rng(2).integers(1, 3, 60)
    tree = SuffixTree(w)
    for i in range(60):
        for j in range(i + 1, 60):
            same = next((k for k in range(60 - j) if w[i + k] != w[j + k]), 60 - j)
            assert tree.common(np.array([i]), np.array([j]))[0] == same


def test_stretches_hold_all_runs():
    """Stretches that touch, repeats far apart and neighbouring documents."""
    rng = np.random.default_rng(4)
    texts = [np.r_[rng.integers(0, 9, 30), np.tile(rng.integers(0, 9, 8), 4), rng.integers(0, 9, 20)] for _ in range(20)]
    texts += [np.tile([1, 2], 20), np.tile([1, 2], 20), np.r_[np.tile([3], 30), np.tile([4], 30)]]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    base = np.cumsum([0] + [len(t) for t in texts])
    spans = repeating_stretches(np.concatenate(texts).astype(np.uint64), owner, 16)
    for d, t in enumerate(texts):
        for s, n, _ in all_runs(t.tolist(), 24, 3):
            assert any(a <= base[d] + s and base[d] + s + n <= b and owner[a] == owner[b - 1] for a, b in spans)


@pytest.mark.parametrize("change", [None, planted])
def test_documents(spark, change):
    rows = corpus(3)
    rng = random.Random(8)
    rows += [(500, " ".join(f"x{k % 7}" for k in range(500))), (501, "a b\t" * 11 + "c " + "a b\n" * 12), (502, "a b " * 11),
             (503, " ".join(rng.choice("ab") for _ in range(3000))), (None, "z " * 30), (500, "again " * 24), (504, " ".join(f"y{k % 997}" for k in range(4000)))]
    got = periodic_runs(frame(spark, rows), change=change).collect()
    want = sorted((row_of(i, t, change) for i, t in rows), key=repr)
    assert sorted(((r["id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], bytes(r["kept"])) for r in got), key=repr) == want
    assert all(len(r["runs"]) == r["n_runs"] for r in got)


def test_empty_table(spark):
    assert periodic_runs(frame(spark, [(1, "a")]).limit(0)).count() == 0
