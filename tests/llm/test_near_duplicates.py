"""The near-duplicate stage against brute force: copies far apart in SimHash, and crowded groups without a centre."""

import random

import numpy as np

from hearthgrid.llm import jaccard
from hearthgrid.llm.simhash import RADIUS, SHINGLE, drop_near_duplicates, fingerprint

from .helpers import frame, words
from .test_dedup import components, similar


def kept_and_wanted(spark, rows):
    text = dict(rows)
    near = [(a, b) for a in text for b in text if a < b and similar(text[a], text[b])]
    return {r["doc_id"] for r in drop_near_duplicates(frame(spark, rows)).collect()}, set(components(text, near).values()), near


def test_appended_and_cut_copies(spark):
    rng, rows = random.Random(11), []
    for k in range(40):
        w = words(rng, rng.choice([12, 60, 100, 400]), 3000)
        other = w + words(rng, int(0.18 * len(w)), 3000) if k % 2 else w[:-max(1, int(0.15 * len(w)))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    kept, wanted, near = kept_and_wanted(spark, rows)
    assert len(near) > 30
    assert kept == wanted


def test_crowded_chain(spark):
    """Each step changes five of 300 words: neighbours are near, the ends are not, and no text is near all."""
    rng = random.Random(12)
    w, texts = [f"n{k}" for k in range(300)], []
    for k in range(150):
        w = list(w)
        for _ in range(5):
            w[rng.randrange(300)] = f"c{rng.random()}"
        texts.append(" ".join(w))
    del texts[70:78]  # two chains
    rng.shuffle(texts)
    kept, wanted, _ = kept_and_wanted(spark, list(enumerate(texts)))
    assert len(wanted) == 2 and kept == wanted


def test_crowded_variants(spark):
    """Variants of one base near the threshold; the smallest id is one of them."""
    rng, base = random.Random(13), [f"n{k}" for k in range(400)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randrange(3, 14)):
            w[rng.randrange(400)] = f"c{rng.random()}"
        rows.append((i, " ".join(w)))
    kept, wanted, _ = kept_and_wanted(spark, rows)
    assert 1 < len(wanted) < 120 and kept == wanted


def test_linked_is_exact():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 60, 50)) for _ in range(80)]
    n = range(len(sets))
    near = [(a, b) for a in n for b in n if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))]
    assert dict(enumerate(jaccard.linked(sets, 0.6).tolist())) == components(n, near)


def test_columns_of_any_name_come_back(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "keep", "x"), (2, text + " more", "gone", "y"), (3, "another text of its own", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kid string, __th string")
    assert sorted(tuple(r) for r in drop_near_duplicates(docs).collect()) == [rows[0], rows[2]]


def test_simhash_finds_what_no_prefix_does(spark, monkeypatch):
    """Without the prefix filter, near copies within the radius are found by their fingerprints, and only they."""
    rng, rows = random.Random(15), []
    for k in range(30):
        w = words(rng, 600, 3000)
        other = list(w)
        other[rng.randrange(600)] = f"c{k}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    text = dict(rows)
    prints = {i: fingerprint(t.encode(), SHINGLE, 42) for i, t in text.items()}
    near = [(a, b) for a in text for b in text if a < b and (prints[a] ^ prints[b]).bit_count() <= RADIUS]
    assert len(near) > 5 and all(similar(text[a], text[b]) for a, b in near)
    monkeypatch.setattr(jaccard, "meetings", lambda texts, *_: texts.sparkSession.createDataFrame([], "a long, b long"))
    kept = {r["doc_id"] for r in drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == set(components(text, near).values())


def test_equal_fingerprints_are_compared(spark):
    """A phrase that fills most of a text sets all bits of the fingerprint; texts that share only it stay."""
    rng = random.Random(16)
    rows = [(k, "again " * 500 + " ".join(words(rng, 100, 3000))) for k in range(6)]
    assert len({fingerprint(t.encode(), SHINGLE, 42) for _, t in rows}) == 1
    kept, wanted, near = kept_and_wanted(spark, rows)
    assert not near and kept == wanted == set(range(6))
