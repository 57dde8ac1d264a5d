"""Line dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from hearthgrid.llm.line_dedup import drop_common_lines, keep_bitmaps, line_verdicts

from .helpers import frame

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least_docs, least_chars=1, keep_first=False):
    keyed = [(i, [(line, line.strip(SPACE).translate(LOWER)) for line in (t or "").split("\n")]) for i, t in rows]
    docs, first = {}, {}
    for i, lines in keyed:
        for pos, (_, key) in enumerate(lines):
            docs.setdefault(key, set()).add(i)
            place = (i is not None, i or 0, pos)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, lines in keyed:
        kept = [line for pos, (line, key) in enumerate(lines) if len(key) < least_chars or len(docs[key]) < least_docs
                or keep_first and first[key] == (i is not None, i or 0, pos)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def texts(seed):
    rng = random.Random(seed)
    pool = ["Home", " home\t", "HOME\r", "Impressum", "École", "éCOLE", " x", " ", "", "  ", "\x0b\x0c", "ÄÖ", "äÖ", "K", "K"]
    rows = [(k, "\n".join(rng.choice(pool + [f"own {rng.randrange(40)}"] * 20) for _ in range(rng.randrange(12)))) for k in range(70)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "home\n" * 5000 + "end"), (None, "home\nown 3"), (None, "home"), (104, "only\nhome\nonly"), (104, "other text\nhome")]
    return rows


@pytest.mark.parametrize("least_docs, least_chars, keep_first", [(10, 1, False), (2, 1, False), (3, 5, False), (2, 1, True)])
def test_lines(spark, least_docs, least_chars, keep_first):
    rows = texts(least_docs)
    if keep_first:
        rows.remove((None, "home"))  # a repeated id, where the hash of the text would decide
    got = drop_common_lines(frame(spark, rows), least_docs=least_docs, least_chars=least_chars, keep_first=keep_first).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, least_docs, least_chars, keep_first)


def test_small_ranges_and_equal_rows(spark):
    rows = texts(9) * 2
    docs = frame(spark, rows, 5)
    dropped = line_verdicts(docs, range_rows=17)
    marks = keep_bitmaps(dropped)
    assert marks.filter(F.aggregate("runs", F.lit(0), lambda a, r: a + r["size"]) != F.col("gone")).count() == 0
    assert sorted(tuple(r) for r in dropped.dropDuplicates().collect() if r[0] is not None) == sorted(
        tuple(r) for r in line_verdicts(frame(spark, rows, 2)).dropDuplicates().collect() if r[0] is not None)
    got = drop_common_lines(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, 10)


def test_empty_table(spark):
    assert drop_common_lines(frame(spark, [(1, "a")]).limit(0)).count() == 0
