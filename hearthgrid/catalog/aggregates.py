"""Aggregation (A), windows and ranking (W), order and set operations (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, scalar as S
from ..operators import graph, spatial, tables
from ..plans import buildings as B, heat as H, network as R
from .base import (AREAS, CELLS, LATTICE, MEMBERS, POSTCODES, SERIES, WAYS, areas, cells, frame, members, postcodes, query, table, ways)
from .joins import box_span

_EAV = """SELECT o_custkey AS feature_id, CASE o_orderkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'Gemeindeschluessel' WHEN 2 THEN 'storeysAboveGround' WHEN 3 THEN 'value' ELSE 'other' END AS name,
 o_orderpriority AS val_string, o_orderkey AS val_int, o_totalprice AS val_double FROM orders"""


@query("a1_eav_pivot", f"""
SELECT feature_id, max(CASE WHEN name = 'function' THEN val_string END) AS code, max(CASE WHEN name = 'Gemeindeschluessel' THEN val_string END) AS ags,
 max(CASE WHEN name = 'storeysAboveGround' THEN val_int END) AS storeys, max(CASE WHEN name = 'value' THEN val_double END) AS height
FROM ({_EAV}) e WHERE name <> 'other' GROUP BY feature_id HAVING max(CASE WHEN name = 'function' THEN val_string END) >= '2' AND max(CASE WHEN name = 'function' THEN val_string END) < '5'""")
def _(spark, sf):
    return tables.eav_pivot(frame(spark, sf, _EAV), ["feature_id"], {
        "code": ("function", "val_string"), "ags": ("Gemeindeschluessel", "val_string"), "storeys": ("storeysAboveGround", "val_int"),
        "height": ("value", "val_double")}).filter("code >= '2' and code < '5'")


@query("a2_grouped_max", f"SELECT feature_id, c_mktsegment, max(CASE WHEN name = 'value' THEN val_double END) AS area FROM ({_EAV}) e JOIN customer ON c_custkey = feature_id GROUP BY 1, 2")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id"), "c_mktsegment")
    wide = tables.eav_pivot(frame(spark, sf, _EAV), ["feature_id"], {"area": ("value", "val_double")})
    have = frame(spark, sf, _EAV).select("feature_id").distinct()
    return have.join(wide, "feature_id", "left").join(c, "feature_id").select("feature_id", "c_mktsegment", "area")


@query("a3_median_with_support", """
SELECT p_brand, p_type, quantile_cont(p_retailprice / p_size, 0.5) AS median, count(*) AS sample_count FROM part GROUP BY 1, 2 HAVING count(*) >= 15""")
def _(spark, sf):
    return tables.median_with_support(table(spark, sf, "part"), ["p_brand", "p_type"], F.col("p_retailprice") / F.col("p_size"), 15)


@query("a4_sum_weights", f"SELECT cx, cy, sum(floor_area * height) AS total FROM ({MEMBERS}) m GROUP BY cx, cy")
def _(spark, sf):
    return members(spark, sf).groupBy("cx", "cy").agg(F.sum(F.col("floor_area") * F.col("height")).alias("total"))


@query("a5_neighbour_count", f"""
SELECT m.id, coalesce(n, 0) AS neighbour_count FROM ({MEMBERS}) m LEFT JOIN (SELECT a.id, count(b.id) AS n FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.id <> b.id AND a.x BETWEEN b.x - 60 AND b.x + 60
 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600 GROUP BY a.id) c ON c.id = m.id""")
def _(spark, sf):
    m = members(spark, sf).select("id", "x", "y")
    return B.neighbour_counts(m, spatial.both_directions(spatial.within_distance_points(m, "id", 60.0))).select("id", "neighbour_count")


@query("a6_conditional_counts", f"""
SELECT cx, cy, count(CASE WHEN segment = 'BUILDING' THEN 1 END) AS n_b, count(CASE WHEN segment = 'MACHINERY' AND floor_area > 100 THEN 1 END) AS n_m, count(*) AS n FROM ({MEMBERS}) m GROUP BY cx, cy""")
def _(spark, sf):
    return members(spark, sf).groupBy("cx", "cy").agg(
        F.count_if(F.col("segment") == "BUILDING").alias("n_b"), F.count_if((F.col("segment") == "MACHINERY") & (F.col("floor_area") > 100)).alias("n_m"),
        F.count("*").alias("n"))


@query("a7_ordered_arrays", """
SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids, arg_min(o_orderkey, o_totalprice) AS first_id, min(least(o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("ids"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("first_id"),
        F.min(F.least("o_totalprice", F.col("o_orderkey").cast("double"))).alias("low"))


_PAIRS = "SELECT CAST(o_custkey AS STRING) AS a, CAST(o_custkey % 700 + 5000000 AS STRING) AS b FROM orders"


@query("a8_component_rollup", f"""
SELECT b AS hub, list(DISTINCT a ORDER BY a) AS members, count(DISTINCT a) AS n FROM ({_PAIRS}) p GROUP BY b HAVING count(DISTINCT a) >= 2""")
def _(spark, sf):
    e = frame(spark, sf, _PAIRS)
    comp = graph.connected_components(e, "a", "b")
    hubs = e.select(F.col("b").alias("node")).distinct().join(comp, "node").select("component", F.col("node").alias("hub"))
    leaves = comp.join(e.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    return leaves.join(hubs, "component").groupBy("hub").agg(
        F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("n")).filter("n >= 2")


@query("a9_ordered_points", """
SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS ordered FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda s: s["o_orderkey"]).alias("ordered"))


@query("a10_sum_lengths", f"SELECT ags, klasse, round(sum(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))), 4) AS total FROM ({WAYS}) w GROUP BY ags, klasse")
def _(spark, sf):
    return ways(spark, sf).groupBy("ags", "klasse").agg(F.round(F.sum(G.length("geom")), 4).alias("total"))


@query("a11_cluster_rollup", f"""
SELECT px, py, list(DISTINCT id ORDER BY id) AS way_ids, min(ags) AS ags FROM (SELECT id, ags, x1 AS px, y1 AS py FROM ({LATTICE}) a UNION ALL SELECT id, ags, x2, y2 FROM ({LATTICE}) b) q
GROUP BY px, py""")
def _(spark, sf):
    n = R.build_nodes(ways(spark, sf, LATTICE))
    return n.select(F.col("geom.x").alias("px"), F.col("geom.y").alias("py"), "way_ids", "ags")


@query("a12_demand_core", """
SELECT user_id, count(value) AS hours, round(avg(value), 6) AS mean, min(value) AS low FROM events WHERE value < 50 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-31' GROUP BY user_id""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.filter((F.col("value") < 50) & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-31").cast("timestamp"))).groupBy("user_id").agg(
        F.count("value").alias("hours"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"))


@query("a13_sum_per_street", "SELECT l_suppkey AS street_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(o, "l_orderkey").groupBy(F.col("l_suppkey").alias("street_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"))


@query("a14_surface_sums", """
SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS wall, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS roof FROM lineitem GROUP BY 1""")
def _(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "A", q)).alias("wall"), F.sum(F.when(F.col("l_returnflag") == "R", q)).alias("roof"))


_LAYERS = """SELECT p_brand AS building_type, p_type AS element_name, CAST(l_orderkey AS STRING) AS construction_data, 1 AS start_year, 2 AS end_year, CAST(l_linenumber AS INTEGER) AS layer_index,
 CAST(l_partkey AS STRING) AS material_name, l_quantity AS thickness, 1e0 AS thermal_conduc, 1e0 AS heat_capac, 1e0 AS density FROM lineitem JOIN part ON p_partkey = l_partkey"""


@query("a15_ordered_layers", f"""
SELECT construction_data, building_type, element_name, list(material_name ORDER BY layer_index DESC, material_name DESC) AS names FROM ({_LAYERS}) l GROUP BY 1, 2, 3""")
def _(spark, sf):
    return H.ordered_layers(frame(spark, sf, _LAYERS)).select(
        "construction_data", "building_type", "element_name", F.transform("layers", lambda v: v["material_name"]).alias("names"))


@query("a16_distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) q WHERE rn = 1")
def _(spark, sf):
    return tables.first_by(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("a17_extent_3d", f"SELECT ags, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(height) AS zmin, max(height) AS zmax FROM ({MEMBERS}) m GROUP BY ags")
def _(spark, sf):
    return members(spark, sf).groupBy("ags").agg(*[
        f(c).alias(f"{a}{n}") for a, c in (("x", "x"), ("y", "y"), ("z", "height")) for f, n in ((F.min, "min"), (F.max, "max"))])


@query("a18_union_area", f"""
SELECT id FROM ({MEMBERS}) m WHERE EXISTS (SELECT 1 FROM ({POSTCODES}) p WHERE plz % 3 = 0 AND x > px1 AND x < px2 AND y > py1 AND y < py2)""")
def _(spark, sf):
    m = members(spark, sf).withColumn("pt", G.make_point("x", "y")).select("id", "pt")
    union = postcodes(spark, sf).filter("plz % 3 = 0").select("plz_geom")
    return spatial.points_in_polygons(m, union, "pt", "plz_geom").select("id").distinct()


@query("a19_scope_box", f"SELECT ags, min(x - half_w) AS xmin, max(y + half_h) AS ymax, left(CAST(ags AS VARCHAR), 1) AS state FROM ({MEMBERS}) m GROUP BY ags")
def _(spark, sf):
    return members(spark, sf).groupBy("ags").agg(F.min(F.col("x") - F.col("half_w")).alias("xmin"), F.max(F.col("y") + F.col("half_h")).alias("ymax")).withColumn(
        "state", F.substring(F.col("ags").cast("string"), 1, 1))


# ---------------------------------------------------------------- W


@query("w1_longest_part", f"""
SELECT ogc_fid, part FROM (SELECT c_custkey AS ogc_fid, i AS part, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_custkey * 7 + i * 5) % 11 DESC, i) AS rn FROM customer, (SELECT unnest([0, 1, 2]) AS i)) q WHERE rn = 1""")
def _(spark, sf):
    # three parts of length (key * 7 + i * 5) % 11 at height i
    c = table(spark, sf, "customer")
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array(
        G.make_point(F.lit(0.0), i), G.make_point((F.col("c_custkey") * 7 + i * 5) % 11, i)))
    return R.longest_part(c.select(F.col("c_custkey").alias("ogc_fid"), parts.alias("parts")), "ogc_fid", "parts").select(
        "ogc_fid", F.get("geom", 0)["y"].cast("int").alias("part"))


@query("w2_rank_in_cell", f"""
SELECT id, CAST(row_number() OVER (PARTITION BY ags, segment ORDER BY floor_area * height, objectid) AS BIGINT) AS rank FROM ({MEMBERS}) m""")
def _(spark, sf):
    m = members(spark, sf).withColumn("v", F.col("floor_area") * F.col("height"))
    return tables.rank_within(m.select("id", "ags", "segment", "v", "objectid"), ["ags", "segment"], [F.col("v"), F.col("objectid")]).select(
        "id", F.col("rank").cast("bigint").alias("rank"))


@query("w3_edge_keys", f"""
SELECT a.id AS source, b.id AS target, 1e0 AS cost FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.id < b.id AND a.x BETWEEN b.x - 60 AND b.x + 60 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600""")
def _(spark, sf):
    p = spatial.within_distance_points(members(spark, sf).select("id", "x", "y"), "id", 60.0)
    return p.select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.lit(1.0).alias("cost"))


@query("w4_next_vertex", f"""
SELECT id, i, vx, vy, lead(vx) OVER (PARTITION BY id ORDER BY i) AS nx FROM (SELECT id, i, CASE WHEN i IN (1, 2) THEN x + half_w ELSE x - half_w END AS vx, CASE WHEN i IN (2, 3) THEN y + half_h ELSE y - half_h END AS vy
 FROM ({MEMBERS}) m, (SELECT unnest([0, 1, 2, 3, 4]) AS i)) q QUALIFY lead(vx) OVER (PARTITION BY id ORDER BY i) IS NOT NULL""")
def _(spark, sf):
    m = members(spark, sf)
    box = G.make_box(F.col("x") - F.col("half_w"), F.col("y") - F.col("half_h"), F.col("x") + F.col("half_w"), F.col("y") + F.col("half_h"))
    return m.select("id", F.posexplode(G.polygon_segments(box)).alias("i", "s")).select("id", "i", F.col("s.ax").alias("vx"), F.col("s.ay").alias("vy"), F.col("s.bx").alias("nx"))


_EPS = 40


@query("w5_cluster_within_eps", f"""
WITH RECURSIVE e AS (SELECT a.id AS s, b.id AS t FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.x BETWEEN b.x - {_EPS} AND b.x + {_EPS} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS * _EPS}),
r AS (SELECT DISTINCT s AS id, s AS node FROM e UNION SELECT r.id, e.t FROM r JOIN e ON r.node = e.s)
SELECT id, min(node) AS cluster FROM r GROUP BY id""")
def _(spark, sf):
    m = members(spark, sf).select("id", "x", "y")
    placed = m.join(spatial.cluster_within(m, float(_EPS)), ["x", "y"])
    return placed.join(placed.groupBy("component").agg(F.min("id").alias("cluster")), "component").select("id", "cluster")


_P0, _P1 = box_span("x1", "y1", "x2", "y2", "px1", "py1", "px2", "py2")


@query("w6_max_overlap", f"""
SELECT id, plz FROM (SELECT id, plz, row_number() OVER (PARTITION BY id ORDER BY round(({_P1} - {_P0}) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) DESC, plz) AS rn
 FROM ({WAYS}) w JOIN ({POSTCODES}) p ON least(x1, x2) <= px2 AND greatest(x1, x2) >= px1 AND least(y1, y2) <= py2 AND greatest(y1, y2) >= py1 WHERE {_P0} <= {_P1}) q WHERE rn = 1""")
def _(spark, sf):
    pairs = spatial.spatial_join(
        spatial.with_line_box(ways(spark, sf).select("id", "geom"), "geom"), spatial.with_polygon_box(postcodes(spark, sf).select("plz", "plz_geom"), "plz_geom"),
        lambda l, r: G.intersects_line_polygon(l("geom"), r("plz_geom")))
    return pairs.withColumn("len", F.round(G.intersection_length("geom", "plz_geom"), 6)).groupBy("id").agg(
        F.min_by("plz", F.struct(-F.col("len"), F.col("plz"))).alias("plz"))


@query("w7_last_year_of_chain", """
SELECT c_custkey, CAST(coalesce(max(CASE WHEN y <= 2020 THEN y END), max(s)) AS INTEGER) AS last FROM (
 SELECT c_custkey, 1900 + c_custkey % 100 AS s, 1900 + c_custkey % 100 + 30 * i AS y FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS i)) q GROUP BY c_custkey""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("start", (F.col("c_custkey") % 100 + 1900).cast("int"))
    plan = H.Refurbishment(30.0, 0.0)
    return c.select("c_custkey", H.last_refurbishment(F.col("start"), F.col("c_custkey").cast("string"), "roof", 2020, plan, 1).alias("last"))


# ---------------------------------------------------------------- O


@query("o1_top_one", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("o2_union_all", "SELECT o_orderkey AS a, o_custkey AS b FROM orders UNION ALL SELECT o_custkey, o_orderkey FROM orders")
def _(spark, sf):
    return spatial.both_directions(table(spark, sf, "orders").select(F.col("o_orderkey").alias("a_k"), F.col("o_custkey").alias("b_k"))).select(
        F.col("a_k").alias("a"), F.col("b_k").alias("b"))


@query("o3_union_distinct", "SELECT o_custkey AS node FROM orders UNION SELECT o_orderkey FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("node")).union(o.select("o_orderkey")).distinct()


@query("o4_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def _(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(
        table(spark, sf, "part").filter("p_size > 25").select("p_partkey"))


@query("o5_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(
        table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_totalprice > 200000").select("o_custkey").distinct())
