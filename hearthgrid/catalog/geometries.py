"""Geometry functions (section G) on shapes derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs, geometry as G, text as T
from ..operators import clip, spatial
from ..plans import buildings as B, network as R
from .base import (AREAS, LATTICE, MEMBERS, POSTCODES, WAYS, areas, frame, members, outlines, postcodes, query, segment_distance_sql,
                   segment_foot_sql, table, ways)
from .joins import box_span


@query("g1_make_point", f"SELECT id, x AS px, y AS py, 25832 AS srid FROM ({MEMBERS}) m")
def _(spark, sf):
    return members(spark, sf).withColumn("p", G.make_point("x", "y")).select("id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.lit(25832).alias("srid"))


# The oracle is the identity: a position survives the way through both other systems to the millimetre.
@query("g2_transform", f"SELECT id, x AS px, y AS py FROM ({MEMBERS}) m")
def _(spark, sf):
    m = members(spark, sf).withColumn("p", G.make_point(F.col("x") + 500000, F.col("y") + 5400000))
    there = crs.transform_point(crs.transform_point("p", 25832, 4326), 4326, 3035)
    return m.withColumn("q", there).withColumn("r", crs.transform_point(crs.transform_point("q", 3035, 4326), 4326, 25832)).select(
        "id", F.round(F.col("r.x") - 500000, 2).alias("px"), F.round(F.col("r.y") - 5400000, 2).alias("py"))


@query("g3_force2d_multi_dump", f"SELECT id, CAST(i AS INTEGER) AS part, x + i AS px FROM ({MEMBERS}) m, (SELECT unnest([0, 1]) AS i)")
def _(spark, sf):
    m = members(spark, sf)
    lines = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.array(
        G.make_point(F.col("x") + i, "y", "height"), G.make_point(F.col("x") + i + 1, "y", "height")))
    poly = F.transform(lines, lambda l: F.array(l))
    return m.select("id", F.posexplode(G.force2d_multi(poly)).alias("part", "g")).select("id", "part", F.get(F.get("g", 0), 0)["x"].alias("px"))


@query("g4_area", f"SELECT id, (2 * half_w) * (2 * half_h) - half_w * half_h AS area FROM ({MEMBERS}) m")
def _(spark, sf):
    m = outlines(spark, sf)
    hole = G.make_box(F.col("x") - F.col("half_w") / 2, F.col("y") - F.col("half_h") / 2, F.col("x") + F.col("half_w") / 2, F.col("y") + F.col("half_h") / 2)
    return m.select("id", G.area(F.concat("geom", hole)).alias("area"))


@query("g5_length", f"SELECT id, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) AS length_geo FROM ({WAYS}) w")
def _(spark, sf):
    return ways(spark, sf).select("id", F.round(G.length("geom"), 6).alias("length_geo"))


@query("g6_centroid", f"SELECT m.id, m.x AS cx, m.y AS cy, m.x + 1 AS lx, m.y AS ly FROM ({MEMBERS}) m")
def _(spark, sf):
    m = outlines(spark, sf)
    line = G.make_line(G.make_point("x", "y"), G.make_point(F.col("x") + 1, "y"), G.make_point(F.col("x") + 2, "y"))
    return m.select("id", F.round(G.centroid_polygon("geom")["x"], 6).alias("cx"), F.round(G.centroid_polygon("geom")["y"], 6).alias("cy"),
                    F.round(G.centroid_line(line)["x"], 6).alias("lx"), F.round(G.centroid_line(line)["y"], 6).alias("ly"))


# An L of two bars: its centroid lies outside, so a point on the scan line half way up is taken.
@query("g7_point_on_surface", f"SELECT id, x + 1 AS px, y + 10 AS py FROM ({MEMBERS}) m")
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    ell = F.array(F.array(*[G.make_point(x + a, y + b) for a, b in ((0, 0), (20, 0), (20, 2), (2, 2), (2, 20), (0, 20), (0, 0))]))
    return members(spark, sf).withColumn("p", G.point_on_surface(ell)).select("id", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("g8_line_ends", f"SELECT id, CAST(x1 AS DOUBLE) AS sx, CAST(y2 AS DOUBLE) AS ey, x1 = x2 AND y1 = y2 AS closed FROM ({WAYS}) w")
def _(spark, sf):
    return ways(spark, sf).select("id", G.start_point("geom")["x"].alias("sx"), G.end_point("geom")["y"].alias("ey"), G.is_closed("geom").alias("closed"))


@query("g9_geometry_guards", f"SELECT id, o % 3 = 2 AS usable, o % 3 = 1 AS empty, CASE WHEN o % 3 <> 0 THEN 'LINESTRING' END AS kind FROM ({WAYS}) w")
def _(spark, sf):
    g = F.when(F.col("o") % 3 == 1, F.array().cast(G.LINE)).when(F.col("o") % 3 == 2, F.col("geom"))
    return ways(spark, sf).withColumn("g", g).select(
        "id", G.usable_line("g").alias("usable"), F.coalesce(G.is_empty("g"), F.lit(False)).alias("empty"), G.geometry_kind("g", "linestring").alias("kind"))


@query("g10_bbox", f"SELECT id, least(x1, x2) - 5e0 AS xmin, greatest(y1, y2) + 5e0 AS ymax, least(x1, x2) - 5 <= 2500 AND greatest(x1, x2) + 5 >= 2000 AND least(y1, y2) - 5 <= 2500 AND greatest(y1, y2) + 5 >= 2000 AS hit FROM ({WAYS}) w")
def _(spark, sf):
    box = F.struct(F.lit(2000.0).alias("xmin"), F.lit(2000.0).alias("ymin"), F.lit(2500.0).alias("xmax"), F.lit(2500.0).alias("ymax"))
    return ways(spark, sf).withColumn("b", G.expand(G.bbox_points("geom"), 5.0)).select("id", "b.xmin", "b.ymax", G.bbox_overlaps("b", box).alias("hit"))


@query("g11_contains", f"SELECT id, plz FROM ({MEMBERS}) m JOIN ({POSTCODES}) p ON x > px1 AND x < px2 AND y > py1 AND y < py2 AND NOT (x >= px1 + 100 AND x <= px1 + 600 AND y >= py1 + 100 AND y <= py1 + 600)")
def _(spark, sf):
    hole = G.make_box(F.col("px1") + 100, F.col("py1") + 100, F.col("px1") + 600, F.col("py1") + 600)
    p = postcodes(spark, sf).withColumn("g", F.concat("plz_geom", hole)).select("plz", "g")
    return spatial.points_in_polygons(members(spark, sf).withColumn("pt", G.make_point("x", "y")).select("id", "pt"), p, "pt", "g").select("id", "plz")


_I0, _I1 = box_span("x1", "y1", "x2", "y2", "px1", "py1", "px2", "py2")


@query("g12_intersects", f"""
SELECT id, plz FROM ({WAYS}) w JOIN ({POSTCODES}) p ON least(x1, x2) <= px2 AND greatest(x1, x2) >= px1 AND least(y1, y2) <= py2 AND greatest(y1, y2) >= py1 WHERE {_I0} <= {_I1}""")
def _(spark, sf):
    return spatial.spatial_join(
        spatial.with_line_box(ways(spark, sf).select("id", "geom"), "geom"), spatial.with_polygon_box(postcodes(spark, sf).select("plz", "plz_geom"), "plz_geom"),
        lambda l, r: G.intersects_line_polygon(l("geom"), r("plz_geom"))).select("id", "plz")


_GAP = "sqrt(power(greatest(a.x - a.half_w - b.x - b.half_w, b.x - b.half_w - a.x - a.half_w, 0), 2) + power(greatest(a.y - a.half_h - b.y - b.half_h, b.y - b.half_h - a.y - a.half_h, 0), 2))"


@query("g13_distance", f"""
SELECT a.id AS a_id, b.id AS b_id, round({_GAP}, 6) AS dist FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.id < b.id AND a.x BETWEEN b.x - 80 AND b.x + 80 AND {_GAP} <= 40""")
def _(spark, sf):
    m = spatial.with_polygon_box(outlines(spark, sf).select("id", "geom"), "geom")
    p = spatial.half_pairs(m, "id", ["geom"], lambda a, b: G.dwithin_polygons(a("geom"), b("geom"), 40.0), 40.0)
    return p.select("a_id", "b_id", F.round(G.distance_polygons("a_geom", "b_geom"), 6).alias("dist"))


_FOOT = segment_foot_sql("x", "y")
_PROBE = f"SELECT w.*, m.x, m.y FROM ({WAYS}) w JOIN ({MEMBERS}) m ON m.id = CAST(floor(o / 10e0) AS BIGINT)"


def _probe(spark, sf):
    return ways(spark, sf, _PROBE).withColumn("pt", G.make_point("x", "y"))


@query("g14_closest_point", f"SELECT id, round(x1 + ({_FOOT}) * (x2 - x1), 6) AS px, round(y1 + ({_FOOT}) * (y2 - y1), 6) AS py, round({segment_distance_sql('x', 'y')}, 6) AS len FROM ({_PROBE}) q")
def _(spark, sf):
    return _probe(spark, sf).withColumn("c", G.shortest_line_point("pt", "geom")).select(
        "id", F.round(F.get("c", 1)["x"], 6).alias("px"), F.round(F.get("c", 1)["y"], 6).alias("py"), F.round(G.length("c"), 6).alias("len"))


@query("g15_line_locate", f"SELECT id, round({_FOOT}, 8) AS f FROM ({_PROBE}) q")
def _(spark, sf):
    return _probe(spark, sf).select("id", F.round(G.line_locate("geom", "pt"), 8).alias("f"))


@query("g16_line_substring", f"SELECT id, round(x1 + 0.25 * (x2 - x1), 6) AS sx, round(y1 + 0.75 * (y2 - y1), 6) AS ey, 2 AS n FROM ({WAYS}) w")
def _(spark, sf):
    return ways(spark, sf).withColumn("s", G.line_substring("geom", 0.25, 0.75)).select(
        "id", F.round(F.get("s", 0)["x"], 6).alias("sx"), F.round(F.get("s", 1)["y"], 6).alias("ey"), F.size("s").alias("n"))


@query("g17_line_interpolate", f"SELECT id, round(x1 + 0.3 * (x2 - x1), 6) AS px, round(y1 + 0.3 * (y2 - y1), 6) AS py FROM ({WAYS}) w")
def _(spark, sf):
    return ways(spark, sf).withColumn("p", G.line_interpolate("geom", 0.3)).select("id", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("g18_make_line", f"SELECT id, 2 AS n, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) AS len FROM ({WAYS}) w")
def _(spark, sf):
    return frame(spark, sf, WAYS).withColumn("g", G.make_line(G.make_point("x1", "y1"), G.make_point("x2", "y2"))).select(
        "id", F.size("g").alias("n"), F.round(G.length("g"), 6).alias("len"))


@query("g19_area3d", f"SELECT id, 2 * half_w * height AS wall, round(2 * half_w * sqrt(power(2 * half_h, 2) + power(height, 2)), 3) AS roof FROM ({MEMBERS}) m")
def _(spark, sf):
    x, y, w, h, z = (F.col(c) for c in ("x", "y", "half_w", "half_h", "height"))
    zero = F.lit(0.0)
    wall = F.array(F.array(F.array(*[G.make_point(a, y, b) for a, b in ((x - w, zero), (x + w, zero), (x + w, z), (x - w, z), (x - w, zero))])))
    roof = F.array(F.array(F.array(*[G.make_point(a, b, c) for a, b, c in ((x - w, y - h, zero), (x + w, y - h, zero), (x + w, y + h, z), (x - w, y + h, z), (x - w, y - h, zero))])))
    return members(spark, sf).select("id", G.area3d(wall).alias("wall"), G.area3d(roof).alias("roof"))


_CUT = "greatest(least(x + 5 * half_w, px2) - greatest(x - 5 * half_w, px1), 0) * greatest(least(y + 5 * half_h, py2) - greatest(y - 5 * half_h, py1), 0)"


@query("g20_clip_polygons", f"SELECT id, round(sum({_CUT}), 4) AS area FROM ({MEMBERS}) m JOIN ({POSTCODES}) p ON plz % 2 = 0 AND {_CUT} > 0 GROUP BY id")
def _(spark, sf):
    m = members(spark, sf).withColumn("g", F.array(G.make_box(
        F.col("x") - 5 * F.col("half_w"), F.col("y") - 5 * F.col("half_h"), F.col("x") + 5 * F.col("half_w"), F.col("y") + 5 * F.col("half_h"))))
    p = postcodes(spark, sf).filter("plz % 2 = 0").select("plz_geom")
    return clip.clip_multi(m.select("id", "g"), "g", p, "plz_geom").select("id", F.round(G.area_multi("g"), 4).alias("area"))


# Areas of every second band, 100 wider on both sides: a chain of overlapping areas along each band. Islands: what they unite to.
_CHAIN = f"SELECT px1 - 100 AS a, px2 + 100 AS z, py1, py2 FROM ({POSTCODES}) p WHERE plz % 2 = 0"
_ISLANDS = f"""
SELECT py1, py2, min(a) AS a, max(z) AS z FROM (
  SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY py1 ORDER BY a) AS isle FROM (
    SELECT *, max(z) OVER (PARTITION BY py1 ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_CHAIN}) c) r) i
GROUP BY py1, py2, isle"""
_CUT_ISLE = "greatest(least(x + 50 * half_w, z) - greatest(x - 50 * half_w, a), 0) * greatest(least(y + 50 * half_h, py2) - greatest(y - 50 * half_h, py1), 0)"


def _chain(spark, sf):
    return frame(spark, sf, _CHAIN).select(G.make_box("a", "py1", "z", "py2").alias("area"))


@query("g20_clip_chain", f"SELECT id, round(sum({_CUT_ISLE}), 4) AS area, count(*) AS parts, 5 * count(*) AS corners FROM ({MEMBERS}) m JOIN ({_ISLANDS}) p ON {_CUT_ISLE} > 0 GROUP BY id")
def _(spark, sf):
    m = members(spark, sf).withColumn("g", F.array(G.make_box(
        F.col("x") - 50 * F.col("half_w"), F.col("y") - 50 * F.col("half_h"), F.col("x") + 50 * F.col("half_w"), F.col("y") + 50 * F.col("half_h"))))
    out = clip.clip_multi(m.select("id", "g"), "g", _chain(spark, sf), "area")
    return out.select("id", F.round(G.area_multi("g"), 4).alias("area"), F.size("g").cast("long").alias("parts"),
                      F.size(F.flatten(F.flatten("g"))).cast("long").alias("corners"))


@query("a18_dissolve", f"SELECT a AS xmin, py1 AS ymin, (z - a) * (py2 - py1) AS area, 5 AS corners FROM ({_ISLANDS}) i")
def _(spark, sf):
    out = clip.dissolve(_chain(spark, sf), "area")
    return out.withColumn("b", G.bbox_multi("area")).select(
        "b.xmin", "b.ymin", G.area_multi("area").alias("area"), F.size(F.flatten(F.flatten("area"))).alias("corners"))


_INSIDE = f"(({_I1}) - ({_I0})) * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))"


@query("g20_clip_lines", f"SELECT id, round(sum({_INSIDE}), 4) AS len FROM ({WAYS}) w JOIN ({POSTCODES}) p ON plz % 2 = 0 AND least(x1, x2) <= px2 AND greatest(x1, x2) >= px1 AND least(y1, y2) <= py2 AND greatest(y1, y2) >= py1 WHERE {_I0} < {_I1} GROUP BY id HAVING sum({_INSIDE}) > 1e-6")
def _(spark, sf):
    p = postcodes(spark, sf).filter("plz % 2 = 0").select("plz_geom")
    out = clip.clip_lines(ways(spark, sf).select("id", "geom"), "geom", p, "plz_geom")
    return out.groupBy("id").agg(F.sum(G.length("geom")).alias("l")).filter("l > 1e-6").select("id", F.round("l", 4).alias("len"))


@query("g21_intersection_length", f"""
SELECT id, plz, round({_INSIDE}, 4) AS len FROM ({WAYS}) w JOIN ({POSTCODES}) p ON least(x1, x2) <= px2 AND greatest(x1, x2) >= px1 AND least(y1, y2) <= py2 AND greatest(y1, y2) >= py1 WHERE {_I0} < {_I1} AND {_INSIDE} > 0.001""")
def _(spark, sf):
    pairs = spatial.spatial_join(
        spatial.with_line_box(ways(spark, sf).select("id", "geom"), "geom"), spatial.with_polygon_box(postcodes(spark, sf).select("plz", "plz_geom"), "plz_geom"))
    return pairs.withColumn("l", G.intersection_length("geom", "plz_geom")).filter("l > 0.001").select("id", "plz", F.round("l", 4).alias("len"))


# Three pieces of one straight line, the middle one reversed: the merge is the whole line.
@query("g22_line_merge", f"SELECT id, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) AS len, 4 AS n FROM ({WAYS}) w")
def _(spark, sf):
    w = ways(spark, sf)
    def at(f):
        return G.line_interpolate("geom", f)

    parts = w.select("id", F.explode(F.array(
        G.make_line(at(0.0), at(0.3)), G.make_line(at(0.6), at(0.3)), G.make_line(at(0.6), at(1.0)))).alias("geom"))
    return R.line_merge(parts, "id", tol=0.001).select("id", F.round(G.length("geom"), 6).alias("len"), F.size("geom").alias("n"))


@query("g23_affine", f"SELECT id, 2 * x + 5 AS px, 3 * y - height AS py, height + 7 AS pz FROM ({MEMBERS}) m")
def _(spark, sf):
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 5, 0, 3, -1, 0, 0, 0, 1, 7)])
    return members(spark, sf).withColumn("p", G.affine_point(G.make_point("x", "y", "height"), m)).select("id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.z").alias("pz"))


# A straight way with a bump of 3 in its middle: tolerance 5 removes it, tolerance 1 keeps it.
@query("g24_simplify", f"SELECT id, 2 AS coarse, 5 AS fine, CAST(x1 AS DOUBLE) AS sx FROM ({WAYS}) w")
def _(spark, sf):
    x, y = F.col("x1"), F.col("y1")
    bump = G.make_line(*[G.make_point(x + a, y + b) for a, b in ((0, 0), (40, 0), (50, 3), (60, 0), (100, 0))])
    return ways(spark, sf).withColumn("b", bump).withColumns({"c": T.simplify("b", 5.0), "f": T.simplify("b", 0.5)}).select(
        "id", F.size("c").alias("coarse"), F.size("f").alias("fine"), F.get("c", 0)["x"].alias("sx"))


@query("g25_wkt_wkb", f"""
SELECT id, 'LINESTRING(' || CAST(CAST(x1 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y1 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(x2 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y2 AS BIGINT) AS VARCHAR) || ')' AS wkt, true AS same FROM ({WAYS}) w""")
def _(spark, sf):
    w = ways(spark, sf).withColumn("wkt", T.to_wkt("geom", "line"))
    return w.select("id", "wkt", ((T.from_wkb(T.to_wkb("geom", "line"), "line") == F.col("geom")) & (T.from_wkt("wkt", "line") == F.col("geom"))).alias("same"))


@query("g26_tile_cover", f"""
SELECT plz, tx * 400 + 100 AS tile_x, ty * 400 + 100 AS tile_y FROM (SELECT plz, px2, py1, py2, unnest(generate_series(CAST(floor((px1 - 100) / 400) AS BIGINT), CAST(floor((px2 - 100) / 400) AS BIGINT))) AS tx FROM ({POSTCODES}) p) q,
 LATERAL (SELECT unnest(generate_series(CAST(floor((py1 - 100) / 400) AS BIGINT), CAST(floor((py2 - 100) / 400) AS BIGINT))) AS ty) l""")
def _(spark, sf):
    return spatial.tile_cover(postcodes(spark, sf).select("plz", "plz_geom"), "plz_geom", 400, 100, 100).select("plz", "tile_x", "tile_y")
