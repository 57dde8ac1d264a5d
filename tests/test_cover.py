"""Cell covers against the plain ring test."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.operators import cover, spatial


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(cx, cy, r, n, phase, dent=0.4):
    return [(cx + (r if k % 2 else r * dent) * math.cos(phase + k * math.pi / n), cy + (r if k % 2 else r * dent) * math.sin(phase + k * math.pi / n)) for k in range(2 * n)]


def shapes():
    rng = random.Random(2)
    out = [[ring([(0, 0), (64, 0), (64, 64), (0, 64)])], [ring([(0, 0), (10, 0), (10, 10), (0, 10)]), ring([(2, 2), (2, 8), (8, 8), (8, 2)])],
           [ring([(-30, -30), (90, -30), (90, -29), (-29, -29), (-29, 90), (-30, 90)])], [ring([(5, 5), (5, 5), (5, 5)])], [ring([(0, 0), (40, 30), (80, 60)])]]
    for k in range(25):
        x, y, r = rng.uniform(-50, 90), rng.uniform(-50, 90), 10 ** rng.uniform(-1, 2)
        shell = star(x, y, r, rng.randrange(3, 60), rng.random())
        out.append([ring(shell), ring(star(x, y, r * 0.2, 4, rng.random()))])
    for k in range(5):  # corners on whole numbers, so points lie on edges and vertices
        out.append([ring([(rng.randrange(-20, 60), rng.randrange(-20, 60)) for _ in range(7)])])
    return out


@pytest.mark.parametrize("boundary", [False, True])
@pytest.mark.parametrize("splits", [1, 3])
def test_points_in_any_shape(spark, boundary, splits):
    rng = random.Random(3)
    pts = [(k, float(rng.randrange(-40, 100)), float(rng.randrange(-40, 100))) for k in range(900)] + [
        (k, rng.uniform(-60, 120), rng.uniform(-60, 120)) for k in range(900, 1500)] + [(2000, None, 1.0)]
    points = spark.createDataFrame(pts, "id long, x double, y double").repartition(3)
    polygons = spark.createDataFrame([(k, s) for k, s in enumerate(shapes())] + [(99, None), (98, [])], f"pid long, g {G.POLYGON}")
    cells = cover.cover_polygons(polygons, "g", splits)
    got = cover.points_in_cover(points, cells, F.col("x"), F.col("y"), boundary).select("id", "pid").collect()
    test = G.covers if boundary else G.contains
    want = points.crossJoin(polygons).filter(test("g", G.make_point("x", "y"))).select("id", "pid").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 300
    assert cells.filter("edges IS NULL").count() > 0


def test_a_polygon_of_many_vertices_spreads(spark):
    n = 100_000
    k = F.col("k") * (2 * math.pi / n)
    r = 1000 + 40 * F.sin(40 * k) + 3 * F.sin(5000 * k)
    at = spark.range(n).select(F.col("id").alias("k")).select("k", (r * F.cos(k)).alias("x"), (r * F.sin(k)).alias("y"))
    ring_ = at.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda p: G.make_point(p["x"], p["y"])).alias("r"))
    polygon = ring_.select(F.array(F.concat("r", F.array(F.get("r", 0)))).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = cover.cover_edges(cover.polygon_edges(polygon.withColumn("pid", F.lit(1)), "g", "pid"), "pid").cache()
        cells.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    partial = cells.filter("edges IS NOT NULL")
    assert partial.agg(F.max(F.size("edges"))).first()[0] < n / 1000
    assert partial.count() > 4000
    spread = partial.select(F.spark_partition_id().alias("p"), F.size("edges").alias("n")).groupBy("p").agg(F.sum("n").alias("n")).toPandas()
    assert len(spread) >= 3 and spread.n.max() < 0.6 * spread.n.sum(), spread
    points = spark.range(3000).select("id", (F.rand(1) * 2400 - 1200).alias("x"), (F.rand(2) * 2400 - 1200).alias("y"))
    got = {r.id for r in cover.points_in_cover(points, cells, F.col("x"), F.col("y")).collect()}
    phi = F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi))
    away = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) - (1000 + 40 * F.sin(40 * phi) + 3 * F.sin(5000 * phi))
    rows = points.select("id", away.alias("d")).collect()
    assert {r.id for r in rows if r.d < -1} <= got and not got & {r.id for r in rows if r.d > 1}


def test_kept_columns_and_semi_join(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0)], "id long, x double, y double").withColumn("p", G.make_point("x", "y"))
    polygons = spark.createDataFrame([("a", [ring([(0, 0), (4, 0), (4, 4), (0, 4)])]), ("b", [ring([(0, 0), (3, 0), (0, 3)])])], f"name string, g {G.POLYGON}")
    got = spatial.points_in_polygons(points, polygons, "p", "g")
    assert got.columns == ["id", "x", "y", "p", "name"] and sorted(r.name for r in got.collect()) == ["a", "b"]
    assert [r.id for r in spatial.points_in_polygons(points, polygons, "p", "g", "left_semi").collect()] == [1]
    assert spatial.points_in_polygons(points, polygons.limit(0), "p", "g").count() == 0


def test_cells_of_a_long_narrow_strip_hold_few_edges(spark):
    # the cells followed the longer side and the number of edges, so on a strip each held more of them the longer it was
    at = F.col("id") * 10.0
    corners = [(at + x, F.lit(y)) for x, y in ((0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0))]
    sides = F.array(*[F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")) for a, b in zip(corners, corners[1:] + corners[:1])])
    edges = spark.range(2000).select(F.lit(0).alias("u"), F.explode(sides).alias("s")).select("u", "s.*")
    cells = cover.cover_edges(edges, "u")
    assert cells.agg(F.max(F.size("edges"))).first()[0] <= 8
    points = spark.range(2000).select((F.col("id") * 10.0 + 2.5).alias("x"), F.lit(2.5).alias("y")).unionByName(
        spark.range(2000).select((F.col("id") * 10.0 + 7.5).alias("x"), F.lit(2.5).alias("y")))
    inside = cover.points_in_cover(points, cells, F.col("x"), F.col("y"))
    assert inside.count() == 2000 and inside.agg(F.max(F.expr("x % 10"))).first()[0] == 2.5
