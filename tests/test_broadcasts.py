"""Sides of joins that grow with the input are not broadcast, however small Spark takes them to be."""

from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.plans import features as FE, network as R


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def store(spark):
    """Three buildings, each a solid that names its wall and its ground."""
    rows = spark.range(3).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).withColumn("fid", F.col("id") * 3 + F.col("i"))
    own = F.concat(F.lit("b"), F.col("id").cast("string"))
    feature = rows.select(F.col("fid").alias("id"), F.element_at(F.array(F.lit(901), F.lit(709), F.lit(710)), F.col("i") + 1).alias("objectclass_id"),
                          F.when(F.col("i") == 0, own).otherwise(F.concat(own, F.lit("_"), F.col("i").cast("string"))).alias("objectid"))
    child = F.when(F.col("i") == 0, F.format_string('{"objectId":"c%d_1"},{"objectId":"c%d_2"}', "id", "id")).otherwise(F.format_string('{"objectId":"c%d_%d"}', "id", "i"))
    geometry = rows.select(F.col("fid").alias("id"), F.col("fid").alias("feature_id"), F.concat(F.lit('{"children":['), child, F.lit("]}")).alias("geometry_properties"),
                           G.make_box(F.lit(0), F.lit(0), F.col("id") + 1, F.lit(1)).alias("geometry"))
    prop = rows.select(F.col("fid").alias("feature_id"), F.when(F.col("i") == 0, "Gemeindeschluessel").otherwise("Flaeche").alias("name"),
                       (F.col("id") + 1).cast("string").alias("val_string"))
    classes = spark.createDataFrame([(709, "WallSurface"), (710, "GroundSurface")], "id int, classname string")
    return feature, geometry, prop, classes


def test_link_surfaces(spark):
    out = FE.link_surfaces(*store(spark))
    assert plan_of(out).count("BroadcastHashJoin") == 1  # the class names
    assert sorted((r["building_objectid"], r["classname"], r["area"], r["gemeindeschluessel"]) for r in out.collect()) == sorted(
        (f"b{k}", name, k + 1.0, str(k + 1)) for k in range(3) for name in ("WallSurface", "GroundSurface"))


def test_building_view(spark):
    out = FE.building_view(spark.range(3).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("objectid")), FE.link_surfaces(*store(spark)))
    assert plan_of(out).count("BroadcastHashJoin") == 1  # the class names
    assert sorted((r["objectid"], r["groundsurface_flaeche"]) for r in out.collect()) == [(f"b{k}", k + 1.0) for k in range(3)]


def test_line_merge(spark, monkeypatch):
    """Three parts per line, one of them turned round, and one ring."""
    plans, cut = [], R.cut_lineage

    def watched(df):
        plans.append(plan_of(df))
        return cut(df)
    monkeypatch.setattr(R, "cut_lineage", watched)

    def at(x, y=0):
        return G.make_point(F.lit(x), F.lit(y))
    lines = F.array(G.make_line(at(0), at(3)), G.make_line(at(6), at(3)), G.make_line(at(6), at(10)))
    ring = F.array(G.make_line(at(0), at(3)), G.make_line(at(3), at(3, 4)), G.make_line(at(3, 4), at(0)))
    parts = spark.range(4).select("id", F.explode(F.when(F.col("id") < 3, lines).otherwise(ring)).alias("geom"))
    out = R.line_merge(parts, "id", tol=0.001)
    plans.append(plan_of(out))
    assert not [p for p in plans if "BroadcastHashJoin" in p]
    assert sorted((r["id"], r["len"], r["n"]) for r in out.select("id", G.length("geom").alias("len"), F.size("geom").alias("n")).collect()) == [
        (0, 10.0, 4), (1, 10.0, 4), (2, 10.0, 4), (3, 12.0, 4)]
