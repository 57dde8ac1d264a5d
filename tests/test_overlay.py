"""Overlay against areas on a fine grid and hand-made shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.operators import clip
from hearthgrid.operators.overlay import polygons_of, rings_of


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def box(x1, y1, x2, y2):
    return [ring([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])]


def polygons(spark, rows, name):
    return spark.createDataFrame([(k, g) for k, g in enumerate(rows)], f"id int, {name} {G.POLYGON}").repartition(3)


def multis(spark, rows, name):
    return spark.createDataFrame(list(rows), f"id int, {name} {G.MULTI}").repartition(3)


def inside(poly, x, y):
    hit = np.zeros(x.shape, dtype=bool)
    for r in poly:
        for a, b in zip(r, r[1:]):
            if a["y"] != b["y"]:
                hit ^= ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))
    return hit


def valid(multi):
    """Rings are closed and simple in their turning: shells left, holes right."""
    for poly in multi:
        for k, r in enumerate(poly):
            assert (r[0]["x"], r[0]["y"]) == (r[-1]["x"], r[-1]["y"]) and len(r) >= 4
            a = sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r, r[1:]))
            assert (a > 0) == (k == 0)


def star(rng, cx, cy, r, n):
    phase = rng.random()
    return ring([(cx + r * (1 if k % 2 else 0.5) * math.cos(phase + k * math.pi / n), cy + r * (1 if k % 2 else 0.5) * math.sin(phase + k * math.pi / n)) for k in range(2 * n)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_areas_and_features_of_any_shape(spark, seed):
    rng = random.Random(seed)
    areas = [[star(rng, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 20), rng.randrange(3, 8))] for _ in range(8)]
    areas += [box(10, 10, 30, 30), box(30, 10, 50, 30), box(30, 30, 50, 40), box(12, 12, 14, 14), [*box(52, 40, 60, 60), *box(54, 45, 57, 50)], areas[0], None]
    features = [(k, [[star(rng, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(2, 25), rng.randrange(3, 6))]]) for k in range(12)]
    features += [(20, [box(-10, -10, 80, 80)]), (21, [box(0, 0, 20, 20), [*box(30, 5, 45, 55), *box(33, 8, 40, 50)]]), (22, [box(13, 13, 13.5, 13.5)]),
                 (23, [box(200, 200, 201, 201)]), (24, [box(10, 10, 30, 30)]), (25, None), (24, [box(10, 10, 30, 30)])]
    got = clip.clip_multi(multis(spark, features, "g"), "g", polygons(spark, areas, "a"), "a").select("id", "g", G.area_multi("g").alias("area")).collect()
    step = 0.05
    x, y = np.meshgrid(np.arange(-12, 82, step) + step / 2, np.arange(-12, 82, step) + step / 2)
    union = np.zeros(x.shape, dtype=bool)
    for a in areas:
        if a is not None:
            union |= inside(a, x, y)
    want = {}
    for k, multi in features:
        covered = np.zeros(x.shape, dtype=bool)
        for poly in multi or []:
            covered |= inside(poly, x, y)
        want[k] = covered & union
    by = {}
    for r in got:
        valid(r["g"])
        by[r["id"]] = r
        seen = np.zeros(x.shape, dtype=bool)
        for poly in r["g"]:
            seen ^= inside(poly, x, y)
        assert (seen != want[r["id"]]).mean() < 1e-5, r["id"]
        assert abs(r["area"] - want[r["id"]].sum() * step * step) < 1 + 0.01 * r["area"]
    assert {k for k, w in want.items() if w.sum() > 40} <= set(by) and sorted(r["id"] for r in got).count(24) == 2
    assert by[22]["area"] == 0.25 and abs(by[24]["area"] - 400) < 1e-6 and 23 not in by and 25 not in by


def test_a_chain_of_areas_is_one_ring(spark):
    """Overlapping, then touching, then repeated; inner edges and cuts are gone."""
    chain = [box(8 * k, 0, 8 * k + 10, 10) for k in range(40)] + [box(8 * 39 + 10, 0, 400, 10), box(0, 0, 10, 10)]
    far = [[*box(1000, 0, 1010, 10), *box(1002, 2, 1008, 8)], box(1003, 3, 1004, 4)]
    got = sorted((r["a"] for r in clip.dissolve(polygons(spark, chain + far, "a"), "a").collect()), key=lambda m: m[0][0][0]["x"])
    assert [[len(r) for r in poly] for multi in got for poly in multi] in ([[5], [5, 5], [5]], [[5], [5], [5, 5]])
    line = clip.clip_multi(multis(spark, [(1, [box(-5, 2, 500, 4)])], "g"), "g", polygons(spark, chain, "a"), "a").collect()
    assert len(line) == 1 and len(line[0]["g"]) == 1 and len(line[0]["g"][0][0]) == 5
    assert sorted({(p["x"], p["y"]) for p in line[0]["g"][0][0]}) == [(0, 2), (0, 4), (400, 2), (400, 4)]


def test_lines(spark):
    areas = [box(0, 0, 10, 10), box(8, 0, 20, 10), box(20, 0, 30, 10), box(40, 0, 50, 10), [ring([(60, 0), (70, 10), (60, 10)])]]
    rows = [(1, [(-5, 5), (55, 5)]), (2, [(2, 10), (25, 10)]), (3, [(1, 1), (2, 2), (3, 1)]), (4, [(-1, -1), (-5, -5)]), (5, [(10, 15), (10, 10), (12, 15)]),
            (6, [(60, 0), (70, 10)]), (7, None), (8, [(5, 5)]), (3, [(1, 1), (2, 2), (3, 1)]), (9, [(5, 5), (5, 20), (15, 20), (15, 5)])]
    df = spark.createDataFrame([(k, p and [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in rows], f"id int, g {G.LINE}").repartition(2)
    got = clip.clip_lines(df, "g", polygons(spark, areas, "a"), "a").select("id", G.length("g").alias("n"), "g").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(round(r["n"], 9))
    assert {k: sorted(v) for k, v in by.items()} == {1: [10.0, 30.0], 2: [23.0], 3: [round(2 * 2 ** 0.5, 9)] * 2, 6: [round(10 * 2 ** 0.5, 9)], 9: [5.0, 5.0]}


def test_nothing(spark):
    areas = polygons(spark, [box(0, 0, 1, 1)], "a")
    layer = multis(spark, [(1, [box(0, 0, 1, 1)])], "g")
    assert clip.clip_multi(layer, "g", areas.limit(0), "a").count() == 0 and clip.clip_multi(layer.limit(0), "g", areas, "a").count() == 0


def test_rings_that_touch():
    """Two squares with a common corner are two shells, a hole that touches its shell stays a ring of its own direction."""
    def edges(*points):
        return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]
    two = np.array(edges((0, 0), (1, 0), (1, 1), (0, 1)) + edges((1, 1), (2, 1), (2, 2), (1, 2)), dtype=float)
    assert sorted(len(p) for p in polygons_of(rings_of(two, np.ones(len(two), dtype=bool)))) == [1, 1]
    cut = np.array(edges((0, 0), (2, 0), (4, 0), (4, 4), (0, 4)), dtype=float)
    assert len(rings_of(cut, np.array([True, False, True, True, True]))[0]) == 5


def test_rings_are_joined_in_batches_of_features(spark, monkeypatch):
    # a pandas group per feature was most of the time of a clip
    from hearthgrid.operators import overlay

    monkeypatch.setattr(overlay, "_STITCHED", 3)
    at = F.col("id") * 10.0
    corners = [F.struct((at + x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0))]
    ring = F.array(*[F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")) for a, b in zip(corners, corners[1:] + corners[:1])])
    # key 4 has an open path only
    arcs = spark.range(8).select("id", F.posexplode(ring).alias("k", "s")).filter("id <> 4 OR k > 0").select("id", "s.*", F.lit(True).alias("own_start"))
    out = overlay.stitch(arcs, "id", "g")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["g"] for r in out.collect()}
    assert set(got) == set(range(8)) - {4}
    for k, multi in got.items():
        (shell,), = multi
        assert {(p["x"], p["y"]) for p in shell} == {(10.0 * k + x, y) for x in (0.0, 2.0) for y in (0.0, 1.0)} and len(shell) == 5
