"""Places and distances are worked out once per row: conditions on them are not pushed below."""

from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.operators import cover, spatial


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_points_in_a_cover(spark):
    area = spark.range(1).select(F.lit(1).alias("aid"), G.make_box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("poly"))
    points = spark.range(8).select("id", (F.col("id") * F.col("id") * F.col("id")).cast("double").alias("c"))
    out = cover.points_in_cover(points, cover.cover_polygons(area, "poly"), F.cbrt("c") * 2, F.cbrt("c") + 1)
    assert plan_of(out).lower().count("cbrt") == 2  # one for x, one for y
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4]
    assert cover.points_in_cover(points.withColumn("c", F.lit(None).cast("double")), cover.cover_polygons(area, "poly"), F.col("c"), F.col("c")).count() == 0


def test_distances_of_the_nearest(spark, monkeypatch):
    plans, cut, distance = [], spatial.cut_lineage, G.distance_point_line

    def watched(df):
        plans.append(plan_of(df).lower())
        return cut(df)
    monkeypatch.setattr(spatial, "cut_lineage", watched)
    monkeypatch.setattr(spatial.G, "distance_point_line", lambda p, line: F.cbrt(F.pow(distance(p, line), F.lit(3))))
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 1.0), (3, 900.0, 0.0)], "id int, x double, y double")
    lines = spark.createDataFrame([("a", 0.0), ("b", 4.0)], "way string, at double").select("way", G.make_line(G.make_point("at", F.lit(-9)), G.make_point("at", F.lit(9))).alias("geom"))
    got = {r.id: (r.way, round(r.dist, 6)) for r in spatial.nearest_within(points, lines, "id", "way", "geom", 20.0, 0.5).collect()}
    assert got == {1: ("b", 4.0), 2: ("b", 1.0)}
    assert plans and max(p.count("cbrt") for p in plans) == 1
