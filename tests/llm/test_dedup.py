"""Exact operators on repeated text against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hearthgrid.llm.simhash import SEED, covering_masks, drop_near_duplicates, fingerprint, simhash_components
from hearthgrid.llm.substring_dedup import cut_repeats, without_repeats
from hearthgrid.llm.suffix_dedup import cut_factors, previous_factors

from .helpers import corpus, frame


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def kept_words(rows, window=20):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            run = b" ".join(w[k:k + window])
            first[run] = min(first.get(run, (i, k)), (i, k))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[b" ".join(w[k:k + window])] < (i, k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def kept_bytes(rows, length=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            first[b[k:k + length]] = min(first.get(b[k:k + length], i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(left), spans, sha(left)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_word_runs(spark, seed):
    rows = corpus(seed)
    rows.append(rows[4])  # a repeated row
    rows.append((rows[5][0], rows[6][1]))  # a repeated id with another text
    got = cut_repeats(frame(spark, rows), block_bytes=5000).collect()
    assert Counter(map(tuple, got)) == Counter(kept_words(rows))


def test_word_runs_stage(spark):
    rows = corpus(3)
    out = without_repeats(frame(spark, rows), size_col="n_chars")
    got = out.collect()
    assert out.columns == frame(spark, rows).columns
    want = {i: d for i, _, _, d in kept_words(rows)}
    assert {r["doc_id"]: sha(r["text"].encode()) for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) and r["id"] == "a" for r in got)


@pytest.mark.parametrize("seed", [1, 4])
def test_factors(spark, seed):
    rows = corpus(seed)
    rows.append(rows[4])
    rows.append((rows[5][0], rows[6][1]))
    got = cut_factors(frame(spark, rows), block_bytes=5000).collect()
    assert Counter(map(tuple, got)) == Counter(kept_bytes(rows))


def test_previous_factors():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60))) for _ in range(12)]
    kid = np.array([rng.randrange(5) for _ in parts])
    part, at = previous_factors(parts, kid, 20)
    want = {(p, k) for p, b in enumerate(parts) for k in range(len(b) - 19)
            if any(kid[q] < kid[p] and b[k:k + 20] in c for q, c in enumerate(parts))}
    assert set(zip(part.tolist(), at.tolist())) == want


def test_null_ids_and_empty_tables(spark):
    rows = [(None, " ".join(f"v{k}" for k in range(60))), (1, " ".join(f"v{k}" for k in range(60))), (2, None)]
    assert {r["id"]: r["n_removed"] for r in cut_repeats(frame(spark, rows)).collect()} == {None: 0, 1: 60, 2: 0}
    assert {r["id"]: r["n_removed"] for r in cut_factors(frame(spark, rows)).collect()} == {None: 0, 1: len(rows[1][1]), 2: 0}
    assert [(r["id"], r["component_id"]) for r in simhash_components(frame(spark, rows[:2])).orderBy("id").collect()] == [(None, 1), (1, 1)]
    none = frame(spark, rows).filter("false")
    for op in (cut_repeats, cut_factors, simhash_components, drop_near_duplicates):
        assert op(none).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 4, 6])
def test_masks_cover(radius):
    rng = random.Random(radius)
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), radius):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)
    assert min(m.bit_count() for m in masks) >= 28 or radius == 0


def components(ids, near):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in near:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rng = random.Random(6)
    rows = corpus(6)
    base = [f"n{k}" for k in range(600)]  # a crowded group of near copies
    for k in range(60):
        w = list(base)
        w[rng.randrange(600)] = f"c{k}"
        rows.append((1000 + k, " ".join(w)))
    got = {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash_components(frame(spark, rows)).collect()}
    fps = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        parts = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(p, SEED) for p in parts]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {i: g[0] for i, g in got.items()} == fps
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: g[1] for i, g in got.items()} == components(fps, near)
    shingle = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert fingerprint(b"A b\tC") == shingle % 2**64


def similar(a, b, width=5):
    def sets(t):
        w = t.encode().lower().split()
        return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    x, y = sets(a or ""), sets(b or "")
    return x == y or len(x & y) >= 0.8 * len(x | y)


def test_near_duplicate_stage(spark):
    rng = random.Random(8)
    rows = corpus(8)
    base = [f"n{k}" for k in range(300)]
    for k in range(40):  # more than a small group, every one close to the first
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(300)] = f"c{rng.random()}"
        rows.append((1000 + k, " ".join(base if not k else w)))
    rows.append(rows[4])
    df = frame(spark, rows)
    out = drop_near_duplicates(df)
    got = out.collect()
    assert out.columns == df.columns
    text = dict(rows)
    near = [(a, b) for a in text for b in text if a < b and similar(text[a], text[b])]
    group = components(text, near)
    kept = Counter(group[r["doc_id"]] for r in got)
    assert set(kept) == set(group.values()) and max(kept.values()) == 1
    assert {r["doc_id"] for r in got} == set(group.values())
