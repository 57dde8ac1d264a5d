"""Distributed operators against brute force, also with a third of the rows in one place."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.operators import clip, graph, spatial, tables


def skewed(n, seed, scale=1000.0):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, scale, n), rng.uniform(0, scale, n)
    x[: n // 3], y[: n // 3] = scale / 2 + rng.normal(0, 0.5, n // 3), scale / 2 + rng.normal(0, 0.5, n // 3)
    return pd.DataFrame({"id": np.arange(n), "x": x, "y": y})


@pytest.mark.parametrize("k", [1, 4])
def test_knn_matches_brute_force(spark, k):
    a, b = skewed(600, 1), skewed(400, 2).rename(columns={"id": "rid", "x": "rx", "y": "ry"})
    b.loc[:20, ["rx", "ry"]] = [500.0, 500.0]
    right = spark.createDataFrame(b).withColumns({"xmin": F.col("rx"), "xmax": F.col("rx"), "ymin": F.col("ry"), "ymax": F.col("ry")})
    got = spatial.knn_join(spark.createDataFrame(a), right, "id", "rid", spatial.point_to_box, k).toPandas()
    d = np.hypot(a.x.values[:, None] - b.rx.values, a.y.values[:, None] - b.ry.values)
    want = np.sort(d, axis=1)[:, :k]
    assert len(got) == want.size
    assert np.allclose(got.sort_values(["id", "dist"]).dist.values, want.ravel())


def test_knn_with_groups_and_radius(spark):
    a = skewed(200, 3).assign(g=lambda d: d.id % 2)
    b = skewed(100, 4).rename(columns={"id": "rid", "x": "rx", "y": "ry"}).assign(g=lambda d: d.rid % 2)
    right = spark.createDataFrame(b).withColumns({"xmin": F.col("rx"), "xmax": F.col("rx"), "ymin": F.col("ry"), "ymax": F.col("ry")})
    got = spatial.knn_join(spark.createDataFrame(a), right, "id", "rid", spatial.point_to_box, radius=30.0, by=["g"]).toPandas()
    d = np.hypot(a.x.values[:, None] - b.rx.values, a.y.values[:, None] - b.ry.values)
    d[a.g.values[:, None] != b.g.values] = np.inf
    want = {i: v for i, v in enumerate(d.min(axis=1)) if v <= 30}
    assert set(got.id) == set(want) and all(np.isclose(r.dist, want[r.id]) for r in got.itertuples())


def test_distance_join_has_every_pair_once(spark):
    a = skewed(500, 5)
    got = spatial.within_distance_points(spark.createDataFrame(a), "id", 3.0).toPandas()
    d = np.hypot(a.x.values[:, None] - a.x.values, a.y.values[:, None] - a.y.values)
    want = {(i, j) for i, j in zip(*np.where(d <= 3.0)) if i < j}
    assert len(got) == len(want) and set(zip(got.a_id, got.b_id)) == want


def test_box_join_with_mixed_sizes_and_negative_coordinates(spark):
    rng = np.random.default_rng(6)
    a = skewed(400, 7).assign(x=lambda d: d.x - 700, y=lambda d: d.y - 300)
    w = rng.uniform(0, 4, 400) * np.where(rng.uniform(size=400) < 0.05, 80, 1)
    a = a.assign(xmin=a.x - w, xmax=a.x + w, ymin=a.y - w / 2, ymax=a.y + w / 2)
    got = spatial.half_pairs(spark.createDataFrame(a), "id", [], lambda l, r: F.lit(True), 0.5).toPandas()
    v = a
    hit = ((v.xmin.values[:, None] - 0.5 <= v.xmax.values) & (v.xmin.values <= v.xmax.values[:, None] + 0.5)
           & (v.ymin.values[:, None] - 0.5 <= v.ymax.values) & (v.ymin.values <= v.ymax.values[:, None] + 0.5))
    want = {(i, j) for i, j in zip(*np.where(hit)) if i < j}
    assert len(got) == len(want) and set(zip(got.a_id, got.b_id)) == want


def test_result_does_not_depend_on_partitions(spark):
    a = spark.createDataFrame(skewed(300, 8))
    one = spatial.within_distance_points(a.coalesce(1), "id", 5.0).select("a_id", "b_id")
    many = spatial.within_distance_points(a.repartition(7), "id", 5.0).select("a_id", "b_id")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_components_on_chain_star_and_isolated_loop(spark):
    edges = [(i, i + 1) for i in range(150)] + [(1000, i) for i in range(1001, 1200)] + [(7000, 7000)]
    got = graph.connected_components(spark.createDataFrame(edges, "source long, target long")).toPandas()
    sizes = got.groupby("component").size().to_dict()
    assert sizes == {0: 151, 1000: 200, 7000: 1}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8)], "parent long, child long")
    got = graph.descendants(spark.createDataFrame([(1,), (6,)], "id long"), e).toPandas()
    depth = {(r.root, r.node): r.depth for r in got.itertuples()}
    assert len(depth) == len(got)
    assert depth[(1, 8)] == 7 and depth[(6, 8)] == 2 and depth[(1, 1)] == 0


def test_rank_within_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 7919) % 1009, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = tables.rank_within(df, ["g"], [F.col("v"), F.col("id")]).toPandas().sort_values(["g", "v", "id"])
    want = np.concatenate([np.arange(1, len(p) + 1) for _, p in got.groupby("g")])
    assert (got["rank"].values == want).all()


def test_interval_lookup(spark):
    """Repeated rows stay, ties go to the earlier start, a NULL key drops out, a NULL year takes the earliest."""
    rows = [(i % 50, i % 3 if i % 7 else None, 1890 + i if i % 11 else None) for i in range(60)] + [(1, 1, 1891)] * 2
    spans = [(k, s, s + 6, f"{k}:{s}") for k in range(3) for s in range(1900, 1940, 10)] + [(0, 1900, 1906, "0:0")]
    got = tables.interval_or_nearest(
        spark.createDataFrame(rows, "id int, k int, year int"), spark.createDataFrame(spans, "k int, start_year int, end_year int, name string"),
        ["k"], "year").select("id", "k", "year", "name").collect()

    def nearest(k, year):
        return min((max(s - year, year - e, 0) if year is not None else 0, s, e, n) for q, s, e, n in spans if q == k)[3]
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, k, y, nearest(k, y))) for i, k, y in rows if k is not None)


def test_rank_with_null_group(spark):
    df = spark.createDataFrame([(g, v) for g in (None, "a") for v in range(9)], "g string, v int")
    got = tables.rank_within(df, ["g"], [F.col("v")], "r").collect()
    assert len(got) == 18 and all(r.r == r.v + 1 for r in got)


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    u = spark.createDataFrame([(2, "B", "Z"), (3, "c", "z")], "k int, v string, w string")
    assert sorted(tables.upsert(t, u, ["k"]).collect()) == [(1, "a", "x"), (2, "B", "Z"), (3, "c", "z")]
    assert sorted(tables.upsert(t, u, ["k"], ["v"]).collect()) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]
    assert sorted(tables.insert_ignore(t, u, ["k"]).collect()) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]


def test_repeated_keys_of_the_source_multiply_nothing(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    u = spark.createDataFrame([(2, "B", "Z"), (2, "A", "Q"), (3, "c", "z"), (3, "c", "z")], "k int, v string, w string")
    assert sorted(tables.upsert(t, u, ["k"]).collect()) == [(1, "a", "x"), (2, "A", "Q"), (3, "c", "z")]
    assert sorted(tables.upsert(t, u, ["k"], ["v"]).collect()) == [(1, "a", "x"), (2, "A", "y"), (3, "c", "z")]
    assert sorted(tables.update_from(t, u, ["k"], {"v": "w"}).collect()) == [(1, "a", "x"), (2, "Q", "y")]


def test_clip_concave_area_with_hole(spark):
    def ring(*xy):
        return F.array(*[G.make_point(F.lit(float(x)), F.lit(float(y))) for x, y in xy])

    area = F.array(ring((0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1)))
    areas = spark.range(1).select(area.alias("a"))
    boxes = spark.createDataFrame([(0, -1, -1, 11, 11), (1, 1, 1, 2, 2), (2, 4, 1, 6, 2), (3, 4, 4, 6, 8), (4, 20, 20, 21, 21)], "id int, x1 int, y1 int, x2 int, y2 int")
    layer = boxes.select("id", F.array(G.make_box("x1", "y1", "x2", "y2")).alias("g"))
    got = {r.id: r.a for r in clip.clip_multi(layer, "g", areas, "a").select("id", G.area_multi("g").alias("a")).collect()}
    assert np.isclose(got[0], 75 - 1) and 1 not in got and np.isclose(got[2], 2) and np.isclose(got[3], 3) and 4 not in got


def test_median(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 4}", None if i % 11 == 0 else float((i * 7919) % 101)) for i in range(1001)]
    rows += [("none", None)] * 6 + [("few", 1.0)] * 4
    got = {r.g: (r.median, r.sample_count) for r in tables.median_with_support(
        spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), 5).collect()}
    want = {k: (float(np.median(v)) if (v := [x for q, x in rows if q == k and x is not None]) else None, sum(q == k for q, _ in rows))
            for k in {r[0] for r in rows} if k != "few"}
    assert got == want


@pytest.mark.parametrize("values, bins", [(4, 64), (50, 16)])
def test_median_by_narrowing(spark, monkeypatch, values, bins):
    """Histograms narrow every group to its middle: ties, infinities, NaN, far outliers, null groups."""
    monkeypatch.setattr(tables, "ORDERED_VALUES", values)
    monkeypatch.setattr(tables, "BINS", bins)
    rng = np.random.default_rng(bins)
    rows = [("hot", float(v)) for v in rng.normal(size=400)] + [(None, float(v)) for v in rng.integers(0, 9, 101)] + [("far", v) for v in (1e300, -1e300, 1.0, 1.5, 2.0, 1e-300)]
    rows += [("inf", v) for v in (float("inf"), float("-inf"), 3.0, float("inf"), float("inf"))] + [("nan", v) for v in (float("nan"), 1.0, 2.0, 3.0, 4.0)] + [("gap", float(v + 1000 * k)) for v in np.arange(60.0) / 64 for k in (0, 1)]
    got = {r.g: r.median for r in tables.median_with_support(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), 1).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted((x for k, x in rows if k == g), key=lambda x: (x != x, x))
        a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
        want[g] = a + (b - a) * 0.5
    assert {k: v for k, v in got.items() if k != "inf"} == {k: v for k, v in want.items() if k != "inf"} and "inf" in got


def test_clusters_of_a_crowded_place(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_SALT_PLACES", 100)
    a = skewed(900, 9)
    a.loc[:50, ["x", "y"]] = [500.0, 500.0]
    got = spatial.cluster_within(spark.createDataFrame(a), 2.0).toPandas()
    pts = a[["x", "y"]].drop_duplicates().to_numpy()
    near = np.hypot(pts[:, 0][:, None] - pts[:, 0], pts[:, 1][:, None] - pts[:, 1]) <= 2.0
    label = np.arange(len(pts))
    for _ in range(len(pts)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert len(got) == len(pts) and got.component.nunique() == len(set(label))


def test_components_with_heavy_nodes(spark, monkeypatch):
    """The way of heavy nodes gives the same components."""
    monkeypatch.setattr(graph, "HEAVY_EDGES", 1)
    monkeypatch.setattr(graph, "HEAVY_SHARE", 10)
    rng = np.random.default_rng(2)
    edges = [(0, int(k)) for k in range(1, 300)] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 200, (150, 2))] + [(2000, 2000)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "source long, target long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_page(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0)]) for i in range(30)],
                               "id int, k int, line array<struct<x:double,y:double>>")
    got = tables.page(df, ["id", "line"], ["id"], 4, 2, equal={"k": 1}, above={"id": 3}, below={"id": 28}, tolerances={"line": 0.1}).collect()
    assert [r.id for r in got] == [i for i in range(4, 28) if i % 5 and i % 3 == 1][2:6] and all(len(r.line) == 2 for r in got)
    assert [r.id for r in tables.page(df, ["id"], ["id"], 2, equal={"k": None}).collect()] == [0, 5]


def test_clip_keeps_equal_rows_and_counts_equal_areas_once(spark):
    area = spark.range(2).select(F.array(F.array(*[G.make_point(F.lit(x), F.lit(y)) for x, y in (
        (0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0))])).alias("a"))
    layer = spark.createDataFrame([(1,), (1,)], "id int").select("id", F.array(G.make_box(F.lit(5.0), F.lit(0.0), F.lit(15.0), F.lit(10.0))).alias("g"))
    got = [r.a for r in clip.clip_multi(layer, "g", area, "a").select(G.area_multi("g").alias("a")).collect()]
    assert np.allclose(got, [50.0, 50.0])


def test_clip_by_overlapping_areas(spark):
    def ring(*xy):
        return F.array(F.array(*[G.make_point(F.lit(float(x)), F.lit(float(y))) for x, y in xy]))

    one = ring((0, 0), (8, 0), (8, 10), (0, 10), (0, 0))
    two = ring((4, 5), (12, 5), (12, 15), (4, 15), (4, 5))
    tilted = ring((20, 0), (30, 5), (25, 15), (15, 10), (20, 0))
    ell = ring((18, 3), (24, 3), (24, 6), (21, 6), (21, 12), (18, 12), (18, 3))
    areas = spark.range(1).select(F.explode(F.array(one, two, tilted, ell)).alias("a"))
    boxes = [(0, -5, -5, 40, 40), (1, 3, 4, 9, 11), (2, 17, 2, 26, 11), (3, 7, 4, 9, 6)]
    layer = spark.createDataFrame(boxes, "id int, x1 int, y1 int, x2 int, y2 int").select(
        "id", F.array(G.make_box("x1", "y1", "x2", "y2")).alias("g"))
    got = {r.id: r.a for r in clip.clip_multi(layer, "g", areas, "a").select("id", G.area_multi("g").alias("a")).collect()}
    x, y = np.meshgrid(np.arange(-5, 40, 0.01) + 0.005, np.arange(-5, 40, 0.01) + 0.005)

    def convex(points):
        inside = np.ones_like(x, dtype=bool)
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
        return inside
    covered = ((x > 0) & (x < 8) & (y > 0) & (y < 10)) | ((x > 4) & (x < 12) & (y > 5) & (y < 15)) | convex(
        [(20, 0), (30, 5), (25, 15), (15, 10)]) | ((x > 18) & (x < 24) & (y > 3) & (y < 6)) | ((x > 18) & (x < 21) & (y > 3) & (y < 12))
    for i, x1, y1, x2, y2 in boxes:
        want = (covered & (x > x1) & (x < x2) & (y > y1) & (y < y2)).sum() * 1e-4
        assert abs(got[i] - want) < 0.05, (i, got[i], want)


def _far_calls(spark, k):
    """How often the exact distance is taken for 20 rows far from all of 2,000 points, and the neighbours found."""
    rng = np.random.default_rng(5)
    right = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((2000, 2)) * (1000, 10))]
    left = [(i, 1e6 + i, 0.5 * i) for i in range(20)]
    calls = spark.sparkContext.accumulator(0)

    def taken(x, y, rx, ry):
        calls.add(1)
        return float(((x - rx) ** 2 + (y - ry) ** 2) ** 0.5)
    exact = F.udf(taken, "double")
    points = spark.createDataFrame(right, "rid long, rx double, ry double").withColumns({"xmin": F.col("rx"), "ymin": F.col("ry"), "xmax": F.col("rx"), "ymax": F.col("ry")})
    got = spatial.knn_join(spark.createDataFrame(left, "id long, x double, y double"), points, "id", "rid",
                           lambda l, r: exact(l("x"), l("y"), r("rx"), r("ry")), k).select("id", "rid").collect()
    want = {(i, r[0]) for i, x, y in left for r in sorted(right, key=lambda r: ((x - r[1]) ** 2 + (y - r[2]) ** 2) ** 0.5)[:k]}
    assert {tuple(r) for r in got} == want and len(got) == 20 * k
    return calls.value


def test_knn_far_rows_meet_a_thin_strip(spark):
    assert _far_calls(spark, 1) <= 5 * 20  # a cell holds about thirty points
    _far_calls(spark, 3)


def test_spatial_join_files_nothing_beyond_the_other_table(spark, monkeypatch):
    """Lines that lie where no polygon is do not become entries of the join."""
    filed, entries = {}, spatial._entries

    def watched(df, eps, others, prefix):
        filed[prefix] = df.count()
        return entries(df, eps, others, prefix)
    monkeypatch.setattr(spatial, "_entries", watched)
    boxes = spatial.with_polygon_box(spark.range(10).select("id", G.make_box(F.col("id") * 10.0, F.lit(0), F.col("id") * 10.0 + 5, F.lit(5)).alias("g")), "g")
    at = F.col("way") * 10.0
    lines = spatial.with_line_box(spark.range(1000).withColumnRenamed("id", "way").select(
        "way", G.make_line(G.make_point(at + 7, F.lit(3)), G.make_point(at + 11, F.lit(3))).alias("geom")), "geom")
    for eps, want, most in ((0.0, {(i + 1, i) for i in range(9)}, 10), (2.0, {(i, i + d) for i in range(10) for d in (-1, 0) if i + d >= 0}, 10)):
        got = spatial.spatial_join(boxes, lines, lambda l, r: G.intersects_line_polygon(r("geom"), l("g")) if not eps else F.lit(True), eps)
        assert {(r["id"], r["way"]) for r in got.collect()} == want
        assert filed["__l_"] <= 10 and filed["__r_"] <= most


def test_filters_on_boxes_do_not_work_out_the_shapes_again(spark):
    # the span of the other table and the bounds that the join infers were pushed below the box: each bound cut the line anew
    w = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double").withColumn(
        "geom", G.make_line(G.make_point("x", F.lit(0.0)), G.make_point(F.col("x") + 1, F.lit(1.0))))
    a = spatial.with_line_box(w.select(F.col("id").alias("a"), G.line_substring("geom", 0.25, 0.75).alias("g")), "g")
    b = spatial.with_line_box(w.select(F.col("id").alias("b"), F.col("geom").alias("h")), "h")
    pairs = spatial.spatial_join(a, b, lambda l, r: G.intersects_lines(l("g"), r("h")))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "Filter " in line.split("(")[0] and "array_min" in line]
    # the shapes are compared behind the boxes
    join = next(line for line in plan if "Join Inner" in line)
    assert join.index("<= __r_xmax") < join.index("exists(")
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(i, i) for i in range(20)]
