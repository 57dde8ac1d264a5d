"""Vector codes against plain k-means in whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from hearthgrid.llm.codes import VectorCodes, decode_codes, fit_codes, hilbert_order, label_errors, nearest, pack_part

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType())])


def plain(rows, parts, entries, rounds, scale=256):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    size = max(len(v) for _, v, _ in kept)
    full = max(1, -(-size // parts)) * parts
    x = np.array([[int(np.floor(float(np.float32(a)) * scale)) for a in v] + [0] * (full - len(v)) for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books, codes, error = [], [], np.zeros(len(kept), dtype=np.int64)
    for p in range(parts):
        e = x[:entries, p].copy()
        for last in [False] * rounds + [True]:
            d = ((x[:, p][:, None] - e[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            if last:
                break
            for k in range(len(e)):
                if (own == k).any():
                    e[k] = x[own == k, p].sum(axis=0) // (own == k).sum()
        books.append(e)
        codes.append(own)
        error += d.min(axis=1)
    by = {}
    for (_, _, y), e in zip(kept, error.tolist()):
        by[y] = by.get(y, 0) + e
    return [(i, c, e, by[y]) for (i, _, y), c, e in zip(kept, np.stack(codes, axis=1).tolist(), error.tolist())], np.stack(books)


def vectors(seed, n=400, size=12):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.normal(size=size) * 0.2).tolist(), int(rng.integers(0, 4))) for k in range(n)]
    for k in range(5, n, 3):  # a third are copies of one vector
        rows[k] = (k, rows[4][1], rows[k][2])
    rows += [(1000, None, 1), (1001, [None] * size, 1), (1002, [float("nan")] * size, 2), (1003, [float("inf")] + [0.0] * (size - 1), 2), (1004, [], None),
             (1005, [0.0] * size, None), (1006, [1.0, -1.0], 1), (7, rows[9][1], 3), (None, [0.5] * size, 0)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "a", 1) for i, v, y in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts, entries, rounds", [(4, 8, 2), (16, 64, 2), (3, 1000, 3), (2, 5, 0)])
def test_codes(spark, parts, entries, rounds):
    rows = vectors(entries)
    coded, books = fit_codes(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    want, want_books = plain(rows, parts, entries, rounds)
    assert books.entries.tolist() == want_books.tolist()
    got = label_errors(coded).select("id", "codes", "error", "label_error").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, c, e, y) for i, c, e, y in want), key=repr)


def test_chunks_and_partitions_change_nothing(spark):
    rows = vectors(3)
    found = []
    for parts, chunk in ((1, 8192), (7, 50)):
        packed = VectorCodes(frame(spark, rows, parts), parts=4, entries=16, chunk=chunk)
        packed.refine()
        found.append((packed.codebooks.digest(), sorted(map(repr, packed.encode().collect()))))
    assert found[0] == found[1]


def test_decoding(spark):
    rows = vectors(5, 40)
    coded, books = fit_codes(frame(spark, rows), parts=4, entries=100, rounds=0)
    back = {r["id"]: r["vector"] for r in decode_codes(coded.filter("id between 100 and 200 or id < 40 and id <> 7"), books).collect()}
    # as many entries as vectors: only the floor is lost
    for i, v, _ in rows[:40]:
        if i != 7:
            assert np.allclose(np.floor(np.float32(v) * 256) / 256, back[i])


def test_short_lists_are_exact():
    rng = np.random.default_rng(1)
    for width in (1, 2, 4, 70):
        points, entries = rng.integers(-90, 90, (300, width)), rng.integers(-90, 90, (13, width))
        assert sorted(hilbert_order(points).tolist()) == list(range(300))
        block = pack_part(points)
        distinct = np.frombuffer(block["points"], dtype="<i4").reshape(-1, width).astype(np.int64)
        low, high, _ = np.frombuffer(block["boxes"], dtype="<i8").reshape(3, -1, width)
        own = np.frombuffer(block["own"], dtype="<i4")
        assert (distinct[own] == points).all()
        entry, distance, _ = nearest(distinct, low, high, entries)
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (entry[own] == d.argmin(axis=1)).all() and (distance[own] == d.min(axis=1)).all()


def test_neighbours_on_the_curve_are_close():
    square = np.array([(a, b) for a in range(16) for b in range(16)])
    walk = square[hilbert_order(square)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_nothing_to_code(spark):
    for rows in (vectors(1, 10)[:0], [(1, None, 1)]):
        coded, books = fit_codes(frame(spark, rows))
        assert coded.count() == 0 and books.entries.size == 0
    with pytest.raises(Exception, match="do not fit"):  # raised in a task
        fit_codes(frame(spark, [(1, [1e30], 1)]))[0].count()


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr("hearthgrid.llm.codes.FEW_LABELS", 2)
    rows = vectors(6, 60)
    coded, _ = fit_codes(frame(spark, rows), parts=4, entries=4)
    want, _ = plain(rows, 4, 4, 2)
    assert sorted(map(repr, (tuple(r) for r in label_errors(coded).select("id", "label_error").collect()))) == sorted(map(repr, ((i, y) for i, _, _, y in want)))
