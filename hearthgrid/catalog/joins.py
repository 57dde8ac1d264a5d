"""Joins (section J) and spatial execution primitives (section X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, scalar as S
from ..operators import spatial, tables
from ..plans import buildings as B, features as FE, heat as H, network as R
from .base import (AREAS, CELLS, MEMBERS, POSTCODES, SERIES, STATIONS, WAYS, ZONE_EDGES, areas, cells, frame, in_zone_sql, members, outlines,
                   point_boxed, postcodes, query, segment_distance_sql, stations, table, ways, zones)


@query("j1_update_from", """
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE c_acctbal END AS o_totalprice FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey = c_custkey""")
def _(spark, sf):
    src = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return tables.update_from(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), src, ["o_custkey"],
                              {"o_totalprice": "c_acctbal"}).select("o_orderkey", "o_totalprice")


@query("j2_grid_join", f"""
SELECT m.cx, m.cy, e.einwohner, h.durchschnhhgroesse, t.freiefh FROM (SELECT DISTINCT cx, cy FROM ({MEMBERS}) q) m
LEFT JOIN (SELECT cx, cy, einwohner FROM ({CELLS}) a WHERE cx % 2 = 0) e ON m.cx = e.cx AND m.cy = e.cy
LEFT JOIN (SELECT cx, cy, durchschnhhgroesse FROM ({CELLS}) b WHERE cy % 2 = 0) h ON m.cx = h.cx AND m.cy = h.cy
LEFT JOIN (SELECT cx, cy, freiefh FROM ({CELLS}) c) t ON m.cx = t.cx AND m.cy = t.cy""")
def _(spark, sf):
    c = cells(spark, sf).withColumnsRenamed({"cx": "x_mp_100m", "cy": "y_mp_100m"})
    grid = members(spark, sf).select(F.col("cx").alias("x_mp"), F.col("cy").alias("y_mp")).distinct()
    key = ["x_mp_100m", "y_mp_100m"]
    out = B.enrich_grid(grid, {
        "people": c.filter("x_mp_100m % 2 = 0").select(*key, "einwohner"), "homes": c.filter("y_mp_100m % 2 = 0").select(*key, "durchschnhhgroesse"),
        "types": c.select(*key, "freiefh")})
    return out.withColumnsRenamed({"x_mp": "cx", "y_mp": "cy"})


@query("j3_point_in_cell", f"""
SELECT m.id, c.cx, c.cy, c.einwohner FROM ({MEMBERS}) m JOIN ({CELLS}) c ON m.x >= c.cx * 500 AND m.x < c.cx * 500 + 500 AND m.y >= c.cy * 500 AND m.y < c.cy * 500 + 500""")
def _(spark, sf):
    m = members(spark, sf).drop("cx", "cy")
    cx, cy = spatial.cell_key("x", "y", 500)
    return m.withColumns({"cx": cx, "cy": cy}).join(cells(spark, sf), ["cx", "cy"]).select("id", "cx", "cy", "einwohner")


@query("j4_point_in_polygon", f"""
SELECT id, plz FROM ({MEMBERS}) m JOIN ({POSTCODES}) p ON x > px1 AND x < px2 AND y > py1 AND y < py2""")
def _(spark, sf):
    m = members(spark, sf).withColumn("pt", G.make_point("x", "y"))
    return spatial.points_in_polygons(m.select("id", "pt"), postcodes(spark, sf).select("plz", "plz_geom"), "pt", "plz_geom").select("id", "plz")


@query("j4_point_in_zone", f"""
SELECT m.id, e.zid FROM ({MEMBERS}) m JOIN ({ZONE_EDGES}) e ON TRUE GROUP BY m.id, e.zid HAVING {in_zone_sql("m.x", "m.y")}""")
def _(spark, sf):
    m = members(spark, sf).withColumn("pt", G.make_point("x", "y"))
    return spatial.points_in_polygons(m.select("id", "pt"), zones(spark, sf), "pt", "zone_geom").select("id", "zid")


_CELL_BOX = f"SELECT DISTINCT cx, cy, ags, cx * 500e0 - 200 AS gx1, cy * 500e0 - 200 AS gy1, cx * 500e0 + 300 AS gx2, cy * 500e0 + 300 AS gy2 FROM ({MEMBERS}) q"


@query("j5_polygon_semi_join", f"""
SELECT DISTINCT g.cx, g.cy, a.ags FROM (SELECT DISTINCT cx, cy, gx1, gy1, gx2, gy2 FROM ({_CELL_BOX}) b) g
JOIN ({AREAS}) a ON gx1 <= ax2 AND ax1 <= gx2 AND gy1 <= ay2 AND ay1 <= gy2
WHERE EXISTS (SELECT 1 FROM ({MEMBERS}) m WHERE m.cx = g.cx AND m.cy = g.cy AND m.ags = a.ags AND m.building_use = 'Residential')""")
def _(spark, sf):
    g = frame(spark, sf, _CELL_BOX).drop("ags").distinct().select(
        F.struct("cx", "cy").alias("cell_id"), G.make_box("gx1", "gy1", "gx2", "gy2").alias("cell_geom"))
    b = members(spark, sf).filter("building_use = 'Residential'").select("ags", F.struct("cx", "cy").alias("cell_id"))
    return B.occupied_cells(g, areas(spark, sf).select("ags", "area_geom"), b, "area_geom").select("cell_id.cx", "cell_id.cy", "ags")


@query("j6_line_in_area", f"""
SELECT w.id, a.ags FROM ({WAYS}) w JOIN ({AREAS}) a ON (x1 + x2) / 2e0 > ax1 AND (x1 + x2) / 2e0 < ax2 AND (y1 + y2) / 2e0 > ay1 AND (y1 + y2) / 2e0 < ay2""")
def _(spark, sf):
    w = ways(spark, sf).select("id", G.centroid_line("geom").alias("c"))
    return spatial.points_in_polygons(w, areas(spark, sf).select("ags", "area_geom"), "c", "area_geom").select("id", "ags")


# A segment meets a box when the part of it inside the box (Liang-Barsky clipping) is not empty.
def _clip_t(lo: bool, p1: str, p2: str, b1: str, b2: str) -> str:
    d = f"({p2} - {p1})"
    near, far = f"least(({b1} - {p1}) / {d}, ({b2} - {p1}) / {d})", f"greatest(({b1} - {p1}) / {d}, ({b2} - {p1}) / {d})"
    empty = f"CASE WHEN {p1} BETWEEN {b1} AND {b2} THEN {0 if lo else 1} ELSE {2 if lo else -2} END"
    return f"CASE WHEN {d} = 0 THEN {empty} ELSE {near if lo else far} END"


def box_span(x1, y1, x2, y2, bx1, by1, bx2, by2) -> tuple[str, str]:
    """First and last position of a segment inside a box, as oracle text."""
    t0 = f"greatest(0e0, {_clip_t(True, x1, x2, bx1, bx2)}, {_clip_t(True, y1, y2, by1, by2)})"
    t1 = f"least(1e0, {_clip_t(False, x1, x2, bx1, bx2)}, {_clip_t(False, y1, y2, by1, by2)})"
    return t0, t1


_T0, _T1 = box_span("x1", "y1", "x2", "y2", "ax1", "ay1", "ax2", "ay2")


@query("j7_line_intersects_area", f"""
SELECT w.id, a.ags FROM ({WAYS}) w JOIN ({AREAS}) a ON least(x1, x2) <= ax2 AND greatest(x1, x2) >= ax1 AND least(y1, y2) <= ay2 AND greatest(y1, y2) >= ay1
WHERE {_T0} <= {_T1}""")
def _(spark, sf):
    return R.named_ways(ways(spark, sf).select("id", "geom"), areas(spark, sf)).select("id", "ags")


@query("j8_distance_join", f"""
SELECT a.id AS a_id, b.id AS b_id FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.id <> b.id AND a.x BETWEEN b.x - 60 AND b.x + 60
 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600""")
def _(spark, sf):
    pairs = spatial.within_distance_points(members(spark, sf).select("id", "x", "y"), "id", 60.0)
    return spatial.both_directions(pairs).select("a_id", "b_id")


@query("j9_theta_distance_join", f"""
SELECT a.id AS a_id, b.id AS b_id FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.id < b.id AND a.ags = b.ags AND a.storeysaboveground = b.storeysaboveground AND a.x BETWEEN b.x - 150 AND b.x + 150
 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 22500 AND abs(a.floor_area - b.floor_area) / greatest(a.floor_area, b.floor_area) < 0.2""")
def _(spark, sf):
    m = point_boxed(members(spark, sf), "x", "y").select("id", "ags", "storeysaboveground", "floor_area", "x", "y", *spatial.BOX)

    def rule(a, b):
        dx, dy = a("x") - b("x"), a("y") - b("y")
        return (dx * dx + dy * dy <= 22500) & (F.abs(a("floor_area") - b("floor_area")) / F.greatest(a("floor_area"), b("floor_area")) < 0.2)

    return spatial.half_pairs(m, "id", ["x", "y", "ags", "storeysaboveground", "floor_area"], rule, 150.0,
                              same=["ags", "storeysaboveground"]).select("a_id", "b_id")


@query("j10_knn_unbounded", f"""
SELECT id, sid, round(sqrt(d2), 6) AS dist FROM (SELECT id, sid, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2,
  row_number() OVER (PARTITION BY id ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), sid) AS rn FROM ({MEMBERS}) m, ({STATIONS}) s) q WHERE rn = 1""")
def _(spark, sf):
    near = spatial.knn_join(members(spark, sf).select("id", "x", "y"), point_boxed(stations(spark, sf).select("sid", "sx", "sy"), "sx", "sy"),
                            "id", "sid", spatial.point_to_box)
    return near.select("id", "sid", F.round("dist", 6).alias("dist"))


_SEG = segment_distance_sql("x", "y")


@query("j11_knn_within_radius", f"""
SELECT id, way_id, round(d, 6) AS dist FROM (SELECT m.id, w.id AS way_id, {_SEG} AS d, row_number() OVER (PARTITION BY m.id ORDER BY {_SEG}, w.id) AS rn
 FROM ({MEMBERS}) m JOIN ({WAYS}) w ON x BETWEEN least(x1, x2) - 100 AND greatest(x1, x2) + 100 AND y BETWEEN least(y1, y2) - 100 AND greatest(y1, y2) + 100
 WHERE {_SEG} <= 100 AND {_SEG} > 0.1) q WHERE rn = 1""")
def _(spark, sf):
    near = spatial.nearest_within(members(spark, sf), ways(spark, sf).select(F.col("id").alias("way_id"), "geom"), "id", "way_id", "geom", 100.0, 0.1)
    return near.select("id", "way_id", F.round("dist", 6).alias("dist"))


@query("j12_preferred_else_nearest", f"""
SELECT m.id, coalesce(d.id, n.way_id) AS assigned_way_id FROM ({MEMBERS}) m LEFT JOIN (SELECT id, o FROM ({WAYS}) w WHERE klasse <> 'connection_line') d ON d.o = m.id * 2
LEFT JOIN (SELECT id, way_id FROM (SELECT m.id, w.id AS way_id, row_number() OVER (PARTITION BY m.id ORDER BY {_SEG}, w.id) AS rn
 FROM ({MEMBERS}) m JOIN ({WAYS}) w ON m.ags = w.ags AND x BETWEEN least(x1, x2) - 2000 AND greatest(x1, x2) + 2000 WHERE {_SEG} <= 2000 AND {_SEG} > 0.1) q WHERE rn = 1) n ON n.id = m.id""")
def _(spark, sf):
    b = members(spark, sf).withColumn("address_street_id", F.col("id") * 2)
    return R.assign_way(b, ways(spark, sf)).select("id", "assigned_way_id")


@query("j13_or_equi_join_nearest", f"""
SELECT id, way_id FROM (SELECT m.id, w.id AS way_id, row_number() OVER (PARTITION BY m.id ORDER BY {_SEG}, w.id) AS rn
 FROM ({MEMBERS}) m JOIN ({WAYS}) w ON m.ags = w.ags AND (m.segment = CASE o % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'X' END OR m.segment = CASE o % 2 WHEN 0 THEN 'HOUSEHOLD' ELSE NULL END)
 AND x BETWEEN least(x1, x2) - 1000 AND greatest(x1, x2) + 1000 WHERE {_SEG} <= 1000) q WHERE rn = 1""")
def _(spark, sf):
    w = ways(spark, sf).withColumns({
        "name": F.when(F.col("o") % 3 == 0, "BUILDING").when(F.col("o") % 3 == 1, "MACHINERY").otherwise("X"),
        "name_kurz": F.when(F.col("o") % 2 == 0, "HOUSEHOLD")}).withColumnRenamed("id", "way_id")
    b = members(spark, sf).withColumn("street", F.concat("segment", F.lit(" 12a")))
    return R.match_address_street(b, w).select("id", F.col("address_street_id").alias("way_id")).filter("way_id is not null")


@query("j14_exists", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)
 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey").join(
        o.filter("o_orderstatus = 'F' and o_totalprice > 300000"), "c_custkey", "left_semi").join(
        o.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("j15_explode_json", """
SELECT l_orderkey AS geometry_id, 'p' || CAST(l_partkey AS VARCHAR) AS child_id FROM lineitem WHERE l_linenumber <> 3""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    child = F.when(F.col("l_linenumber") == 3, F.lit("{}")).otherwise(F.format_string('{"objectId":"p%d"}', "l_partkey"))
    g = li.groupBy("l_orderkey").agg(F.collect_list(child).alias("c")).select(
        F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("feature_id"),
        F.concat(F.lit('{"type":9,"children":['), F.array_join("c", ","), F.lit("]}")).alias("geometry_properties"))
    return FE.child_objects(g).select("geometry_id", "child_id")


@query("j16_explode_split", "SELECT c_custkey, unnest(string_split(c_name || ';' || c_mktsegment || ' 7', ';')) AS street FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.explode(F.split(F.concat("c_name", F.lit(";"), "c_mktsegment", F.lit(" 7")), ";")).alias("street"))


@query("j17_text_key_self_join", """
SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON 'child-' || CAST(a.o_orderkey AS VARCHAR) = 'child-' || CAST(b.o_orderkey * 2 AS VARCHAR) AND b.o_orderstatus = 'F'""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("a_key"), F.concat(F.lit("child-"), F.col("o_orderkey").cast("string")).alias("child"))
    b = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("b_key"), F.concat(F.lit("child-"), (F.col("o_orderkey") * 2).cast("string")).alias("child"))
    return a.join(b, "child").select("a_key", "b_key")


@query("j18_star_join_time_range", f"""
SELECT m.objectid, e.event_id, e.value / m.height AS load FROM ({MEMBERS}) m JOIN customer c ON c_custkey = m.id JOIN nation ON c_nationkey = n_nationkey
 JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'view') s ON s.user_id = m.id JOIN events e ON e.user_id = s.user_id
WHERE n_regionkey = 1 AND e.ts >= TIMESTAMP '2024-01-03' AND e.ts < TIMESTAMP '2024-01-20' AND e.value < 50""")
def _(spark, sf):
    e = table(spark, sf, "events")
    series = e.filter("event_type = 'view'").select("user_id").distinct()
    hours = e.filter((F.col("ts") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("value") < 50))
    home = members(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id").join(
        table(spark, sf, "nation").filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    return home.join(series.withColumnRenamed("user_id", "id"), "id").join(hours.withColumnRenamed("user_id", "id"), "id").select(
        "objectid", "event_id", (F.col("value") / F.col("height")).alias("load"))


@query("j19_catalogue_join", """
SELECT l_orderkey, l_linenumber, p_partkey, regexp_replace(p_name, '^.* ', '') AS building_type, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_type <> 'ECONOMY'""")
def _(spark, sf):
    el = table(spark, sf, "part").select(F.col("p_partkey").alias("element_id"), F.col("p_type").alias("kind"), F.regexp_replace("p_name", " ", "_").alias("construction_data"),
                                         F.when(F.col("p_type") == "ECONOMY", "Door").otherwise("OuterWall").alias("element_name"), F.lit(1900).alias("start_year"), F.lit(1910).alias("end_year"))
    la = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("element_id"), F.col("l_suppkey").alias("material_id"), F.col("l_linenumber").alias("layer_index"),
                                             F.col("l_orderkey").alias("thickness"))
    ma = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("material_id"), F.col("s_name").alias("material_name"),
                                             F.lit(1.0).alias("thermal_conduc"), F.lit(1.0).alias("heat_capac"), F.lit(1.0).alias("density"))
    # the part key rides along as the name of the construction
    el = el.withColumn("construction_data", F.concat(F.col("element_id").cast("string"), F.lit("#"), F.col("construction_data")))
    out = H.catalogue(el, la, ma)
    return out.select(F.col("thickness").alias("l_orderkey"), F.col("layer_index").alias("l_linenumber"),
                      F.split("construction_data", "#")[0].cast("bigint").alias("p_partkey"),
                      F.regexp_replace("building_type", "^.*#", "").alias("building_type"), F.col("material_name").alias("s_name"))


_INTERVALS = "SELECT n_regionkey AS grp, n_nationkey AS k, 2 + n_nationkey * 2 AS start_year, 3 + n_nationkey * 2 AS end_year FROM nation"


@query("j20_interval_or_nearest", f"""
SELECT p_partkey, k FROM (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY greatest(start_year - p_size, p_size - end_year, 0), start_year, end_year) AS rn
 FROM part JOIN ({_INTERVALS}) i ON grp = p_partkey % 5) q WHERE rn = 1""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("grp"), F.col("p_size").alias("year"))
    return tables.interval_or_nearest(p, frame(spark, sf, _INTERVALS), ["grp"], "year", ["p_partkey"]).select("p_partkey", "k")


@query("j21_reassign", f"""
SELECT m.id, CASE WHEN m.id % 3 = 0 THEN CAST(m.id + 1 AS VARCHAR) WHEN m.id % 3 = 1 THEN coalesce(n.way_id, CAST(m.id AS VARCHAR)) ELSE CAST(m.id AS VARCHAR) END AS assigned_way_id FROM ({MEMBERS}) m
LEFT JOIN (SELECT id, way_id FROM (SELECT m.id, w.id AS way_id, row_number() OVER (PARTITION BY m.id ORDER BY {_SEG}, w.id) AS rn
 FROM ({MEMBERS}) m JOIN ({WAYS}) w ON m.id % 3 = 1 AND m.ags = w.ags AND w.id <> CAST(m.id AS VARCHAR) AND x BETWEEN least(x1, x2) - 2000 AND greatest(x1, x2) + 2000 WHERE {_SEG} <= 2000 AND {_SEG} > 0.1) q WHERE rn = 1) n ON n.id = m.id""")
def _(spark, sf):
    b = members(spark, sf).withColumn("assigned_way_id", F.col("id").cast("string"))
    mapping = b.filter("id % 3 < 2").select(F.col("assigned_way_id").alias("old_way_id"), F.when(F.col("id") % 3 == 0, (F.col("id") + 1).cast("string")).alias("new_way_id"))
    return R.reassign(b, mapping, ways(spark, sf)).select("id", "assigned_way_id")


@query("j22_existence_filter", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 2)")
def _(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(n, "s_nationkey", "left_semi").select("s_suppkey")


@query("j23_default_join", """
SELECT c_custkey, coalesce(t, 0) AS total, CASE WHEN c_acctbal > 0 THEN coalesce(t, 0) / c_acctbal ELSE 0 END AS ratio FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_orderkey AS BIGINT)) AS DOUBLE) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey""")
def _(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_orderkey").cast("double").alias("t"))
    total = F.coalesce("t", F.lit(0.0))
    return table(spark, sf, "customer").join(o, "c_custkey", "left").select(
        "c_custkey", total.alias("total"), F.when(F.col("c_acctbal") > 0, F.try_divide(total, F.col("c_acctbal"))).otherwise(F.lit(0.0)).alias("ratio"))


@query("j24_preaggregated_join", """
SELECT c_custkey, w AS wall, r AS roof FROM customer LEFT JOIN (SELECT o_custkey, sum(o_orderkey)::BIGINT AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, sum(o_orderkey)::BIGINT AS r FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("wall"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("roof"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")


# ---------------------------------------------------------------- X

_BOXES = f"SELECT id, x - half_w * (CASE WHEN id % 50 = 0 THEN 40 ELSE 1 END) AS bx1, x + half_w * (CASE WHEN id % 50 = 0 THEN 40 ELSE 1 END) AS bx2, y - half_h AS by1, y + half_h AS by2 FROM ({MEMBERS}) m"


@query("x1_spatial_join", f"""
SELECT b.id, s.id AS way_id FROM ({_BOXES}) b JOIN ({WAYS}) s ON least(x1, x2) <= bx2 AND greatest(x1, x2) >= bx1 AND least(y1, y2) <= by2 AND greatest(y1, y2) >= by1
WHERE {box_span('x1', 'y1', 'x2', 'y2', 'bx1', 'by1', 'bx2', 'by2')[0]} <= {box_span('x1', 'y1', 'x2', 'y2', 'bx1', 'by1', 'bx2', 'by2')[1]}""")
def _(spark, sf):
    b = frame(spark, sf, _BOXES).withColumn("g", G.make_box("bx1", "by1", "bx2", "by2"))
    left = spatial.with_polygon_box(b.select("id", "g"), "g")
    right = spatial.with_line_box(ways(spark, sf).select(F.col("id").alias("way_id"), "geom"), "geom")
    return spatial.spatial_join(left, right, lambda l, r: G.intersects_line_polygon(r("geom"), l("g"))).select("id", "way_id")


@query("x2_knn_join", f"""
SELECT id, sid, CAST(rn AS INTEGER) AS rank FROM (SELECT id, sid, row_number() OVER (PARTITION BY id ORDER BY sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), sid) AS rn FROM ({MEMBERS}) m, ({STATIONS}) s) q WHERE rn <= 3""")
def _(spark, sf):
    return spatial.knn_join(members(spark, sf).select("id", "x", "y"), point_boxed(stations(spark, sf).select("sid", "sx", "sy"), "sx", "sy"),
                            "id", "sid", spatial.point_to_box, k=3).select("id", "sid", "rank")


@query("x3_cover_cells", f"""
SELECT id, gx, gy, gx > bx1 AND gx + 20 < bx2 AND gy > by1 AND gy + 20 < by2 AS full FROM (SELECT id, bx1 - 10 AS bx1, bx2 + 10 AS bx2, by1 - 10 AS by1, by2 + 10 AS by2,
  unnest(generate_series(CAST(floor((bx1 - 10) / 20) AS BIGINT), CAST(ceil((bx2 + 10) / 20) AS BIGINT) - 1)) * 20e0 AS gx FROM ({_BOXES}) b) q,
  LATERAL (SELECT unnest(generate_series(CAST(floor(by1 / 20) AS BIGINT), CAST(ceil(by2 / 20) AS BIGINT) - 1)) * 20e0 AS gy) l""")
def _(spark, sf):
    b = frame(spark, sf, _BOXES).withColumn("g", G.make_box(F.col("bx1") - 10, F.col("by1") - 10, F.col("bx2") + 10, F.col("by2") + 10))
    return spatial.cover_cells(b.select("id", "g"), "g", 20).select("id", "gx", "gy", "full")
