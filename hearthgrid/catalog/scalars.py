"""Casts, filters, predicates and scalar functions (sections C and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs, geometry as G, scalar as S, text as T
from ..operators import tables
from ..plans import buildings as B, heat as H, network as R
from .base import CELLS, MEMBERS, WAYS, cells, frame, members, query, table, ways

_TEXTS = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN '-' WHEN 2 THEN '–' WHEN 3 THEN '' ELSE CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) || ' m' END AS whole,
       CASE l_linenumber WHEN 1 THEN '—' WHEN 2 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',25' END AS deci FROM lineitem"""


@query("c1_cast_int_lenient", f"""
SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(nullif(regexp_replace(CASE WHEN trim(whole) IN ('-', '–', '—') THEN NULL ELSE whole END, '[^0-9-]', '', 'g'), '') AS BIGINT) AS n
FROM ({_TEXTS}) t""")
def _(spark, sf):
    return frame(spark, sf, _TEXTS).select("l_orderkey", "l_linenumber", "l_partkey", S.cast_int_lenient("whole").alias("n"))


@query("c2_cast_decimal_comma", f"""
SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(nullif(replace(CASE WHEN trim(deci) IN ('-', '–', '—') THEN NULL ELSE deci END, ',', '.'), '') AS DOUBLE) AS v
FROM ({_TEXTS}) t""")
def _(spark, sf):
    return frame(spark, sf, _TEXTS).select("l_orderkey", "l_linenumber", "l_partkey", S.cast_decimal_comma("deci").alias("v"))


@query("c3_cast_by_map", """
SELECT l_orderkey AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_partkey AS DOUBLE) AS y, l_suppkey AS n, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',5' AS note, CAST(l_quantity AS BIGINT) + 0.5e0 AS v
FROM lineitem""")
def _(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey as string) L_ORDERKEY", "cast(l_linenumber as string) X", "cast(l_partkey as string) y", "cast(l_suppkey as string) N",
        "cast(cast(l_quantity as bigint) as string) || ',5' note", "cast(cast(l_quantity as bigint) as string) || ',5' V")
    return S.cast_by_map(raw, {"l_orderkey": "BIGINT", "N": "Integer", "v": "double precision"})


@query("c5_resolve_scope", """
SELECT DISTINCT c_name AS ags FROM customer WHERE c_name LIKE 'Customer#00000001%' OR c_name LIKE '%7_' """)
def _(spark, sf):
    pats = S.resolve_scope(["Customer#00000001", "%7_", " "])
    return table(spark, sf, "customer").filter(S.like_any("c_name", pats)).select(F.col("c_name").alias("ags")).distinct().orderBy("ags")


@query("c6_materialize_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    keys = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left_semi")


_CODES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '31001_2463' WHEN 1 THEN '31001_2513' WHEN 2 THEN '51001_1000' WHEN 3 THEN NULL ELSE '31001_1000' END AS building_function_code,
 CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS geom FROM part"""


@query("c7_select_buildings", f"""
SELECT p_partkey, building_function_code FROM ({_CODES}) c WHERE building_function_code LIKE '31001_%' AND building_function_code NOT IN ('31001_2463', '31001_2513') AND geom IS NOT NULL""")
def _(spark, sf):
    return B.select_buildings(frame(spark, sf, _CODES)).select("p_partkey", "building_function_code")


@query("c8_drop_low_small", """
SELECT p_partkey, h, a FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size / 4e0 END AS h, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS a FROM part) q
WHERE (h IS NULL OR h >= 3.5) AND (a IS NULL OR a >= 12)""")
def _(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size / 4e0 END AS h",
                                            "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS a")
    return B.drop_small(B.drop_low(p, "h"), "a")


@query("c9_filter_ways", """
SELECT o_orderkey, o_orderpriority AS klasse, o_orderstatus AS objektart FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND NOT (o_orderpriority = '1-URGENT' AND o_orderstatus NOT IN ('F', 'O')) AND NOT (o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P')""")
def _(spark, sf):
    w = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("klasse"), F.col("o_orderstatus").alias("objektart"))
    return R.filter_ways(w, ["1-URGENT", "2-HIGH", "3-MEDIUM"], {"1-URGENT": ["F", "O"], "2-HIGH": ["P"]})


_NAMES = "SELECT p_partkey, p_brand || ' und ' || p_name || '/Straße-ä, ' || p_type AS category FROM part"


@query("c10_rename_slug", f"""
SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(replace(category, 'und ', ''), ' ', '_'), '-', ''), '/', '_'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), ',', '') AS slug
FROM ({_NAMES}) n""")
def _(spark, sf):
    return frame(spark, sf, _NAMES).select("p_partkey", S.rename_slug("category").alias("slug"))


# the id itself is a digest of bytes that SQL cannot write; what it must do is tell exact places apart
@query("c11_stable_geom_id", f"""
SELECT id, min(id) OVER (PARTITION BY x, y, k) AS first_id, CAST(32 AS INTEGER) AS digits
FROM (SELECT id, x, y, id % 3 AS k FROM ({MEMBERS}) m) q""")
def _(spark, sf):
    # places that differ in the last bits only
    m = members(spark, sf).withColumn("geom_id", T.stable_geom_id(G.make_point(F.col("x") + (F.col("id") % 3) * 1e-11 * F.col("x"), "y"), "point"))
    first = m.groupBy(F.col("geom_id").alias("g")).agg(F.min("id").alias("first_id"))
    return m.join(first, F.col("geom_id") == F.col("g")).select("id", "first_id", F.length("geom_id").alias("digits"))


@query("c12_normalize_srid", f"""
SELECT id, CASE WHEN o % 2 = 0 THEN 25832 ELSE 0 END AS srid, 25832 AS srid_out, CAST(x1 AS DOUBLE) AS x, CAST(y2 AS DOUBLE) AS y FROM ({WAYS}) w""")
def _(spark, sf):
    # every third way is first moved to another system, which the operator has to undo
    w = ways(spark, sf).withColumn("moved", (F.col("o") % 3 == 0))
    w = w.withColumn("srid", F.when(F.col("moved"), 4326).when(F.col("o") % 2 == 0, 25832).otherwise(0))
    shifted = F.transform("geom", lambda p: G.make_point(p["x"] + 600000, p["y"] + 5300000))
    w = w.withColumn("g", F.when(F.col("moved"), crs.transform_line(shifted, 25832, 4326)).otherwise(shifted))
    line, srid = crs.normalize_srid("g", "srid", [4326], 25832)
    return w.select("id", F.when(F.col("o") % 2 == 0, 25832).otherwise(0).alias("srid"), srid.alias("srid_out"),
                    F.round(F.get(line, 0)["x"] - 600000, 3).alias("x"), F.round(F.get(line, 1)["y"] - 5300000, 3).alias("y"))


@query("c13_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_orderkey LIMIT 100 OFFSET 20")
def _(spark, sf):
    return tables.page(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], ["o_orderkey"], 100, 20,
                       equal={"o_orderstatus": "F"}, above={"o_totalprice": 100000})


@query("c14_demand_overview", f"""
SELECT m.objectid AS building_objectid, m.floor_area * 4 AS demand_kwh, CASE WHEN storeysaboveground IS NULL THEN NULL ELSE m.floor_area * 4 / (m.floor_area * storeysaboveground) END AS demand_per_area, height AS resistance, building_use
FROM ({MEMBERS}) m WHERE id % 2 = 0""")
def _(spark, sf):
    m = members(spark, sf)
    status = m.select(F.col("objectid").alias("building_objectid"), "floor_area", F.col("storeysaboveground").alias("floor_number"))
    demand = m.filter("id % 2 = 0").select(F.col("objectid").alias("building_objectid"), (F.col("floor_area") * 4).alias("demand_kwh"))
    rc = m.select(F.col("objectid").alias("building_objectid"), F.col("height").alias("resistance"))
    return H.demand_overview(status, demand, rc, m.select("objectid", "building_use", "floor_area")).select(
        "building_objectid", "demand_kwh", "demand_per_area", "resistance", "building_use")


# ---------------------------------------------------------------- F

_STREETS = "SELECT c_custkey, '  ' || CASE WHEN c_custkey % 3 = 0 THEN 'Am Markt' ELSE 'Weg ' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE '' END END || ' ' AS street FROM customer"


@query("f1_split_street", rf"""
SELECT c_custkey, regexp_replace(trim(street), '\s*\d+[\w,]*$', '') AS street, nullif(regexp_extract(trim(street), '\s*(\d+[\w,]*)$', 1), '') AS house_number FROM ({_STREETS}) s""")
def _(spark, sf):
    return frame(spark, sf, _STREETS).select("c_custkey", S.street_name("street").alias("street"), S.house_number("street").alias("house_number"))


@query("f2_text_ranges", "SELECT p_partkey, left(p_brand, 6) AS k FROM part WHERE p_brand LIKE 'Brand#1_' AND p_type >= 'E' AND p_type < 'P'")
def _(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_brand").like("Brand#1_") & (F.col("p_type") >= "E") & (F.col("p_type") < "P")).select(
        "p_partkey", F.substring("p_brand", 1, 6).alias("k"))


@query("f3_grid_id", f"SELECT DISTINCT '500mN' || CAST(cy * 500 AS VARCHAR) || 'E' || CAST(cx * 500 AS VARCHAR) AS id FROM ({MEMBERS}) m")
def _(spark, sf):
    return members(spark, sf).select(S.grid_id("500m", F.col("cy") * 500, F.col("cx") * 500).alias("id")).distinct()


_RES = "SELECT p_partkey, CAST(p_size AS STRING) || CASE p_partkey % 3 WHEN 0 THEN 'km' WHEN 1 THEN 'm' ELSE 'ft' END AS res FROM part"


@query("f4_resolution_meters", f"""
SELECT p_partkey, CAST(CASE WHEN res LIKE '%km' THEN CAST(replace(res, 'km', '') AS INTEGER) * 1000 WHEN res LIKE '%ft' THEN NULL ELSE CAST(replace(res, 'm', '') AS INTEGER) END AS INTEGER) AS meters
FROM ({_RES}) r""")
def _(spark, sf):
    return frame(spark, sf, _RES).select("p_partkey", S.resolution_meters("res").alias("meters"))


def use_codes(spark, sf):
    return members(spark, sf).select(F.col("building_use_id").alias("code"), "building_use").distinct()


@query("f5_classify_use", f"SELECT id, building_use FROM ({MEMBERS}) m")
def _(spark, sf):
    # every code is listed twice
    more = use_codes(spark, sf).unionByName(use_codes(spark, sf))
    return S.classify_use_by_list(members(spark, sf).select("id", "building_use_id"), "building_use_id", more).select("id", "building_use")


@query("f5_classify_use_by_list", f"SELECT id, building_use FROM ({MEMBERS}) m")
def _(spark, sf):
    m = members(spark, sf)
    return S.classify_use_by_list(m.select("id", "building_use_id"), "building_use_id", use_codes(spark, sf)).select("id", "building_use")


_UNIFORM = "CAST(('0x' || substr(md5('42:' || {k}), 1, 8))::UBIGINT AS DOUBLE) / 4294967295e0"


@query("f6_weighted_choice", f"""
SELECT id, CASE WHEN t <= 0 THEN NULL WHEN r <= a / t THEN 'low' WHEN r <= (a + b) / t THEN 'mid' ELSE 'high' END AS label
FROM (SELECT id, {_UNIFORM.format(k='objectid')} AS r, CAST(id % 5 AS DOUBLE) AS a, CAST(id % 3 AS DOUBLE) AS b, CAST(id % 2 AS DOUBLE) AS c, CAST(id % 5 + id % 3 + id % 2 AS DOUBLE) AS t FROM ({MEMBERS}) m) q""")
def _(spark, sf):
    w = [(F.col("id") % k).cast("double") for k in (5, 3, 2)]
    return members(spark, sf).withColumn("r", S.hash_uniform(42, "objectid")).select(
        "id", S.weighted_choice(w, ["low", "mid", "high"], "r").alias("label"))


@query("f7_hash_uniform", f"SELECT c_custkey, {_UNIFORM.format(k='CAST(c_custkey AS VARCHAR)')} AS r FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.hash_uniform(42, "c_custkey").alias("r"))


@query("f8_nan_to_zero", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE l_quantity END AS q FROM lineitem")
def _(spark, sf):
    q = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(None)).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.nan_to_zero(q).alias("q"))


@query("f9_number_rules", """
SELECT l_orderkey, l_linenumber, l_partkey, greatest(round_even(l_quantity / 4, 0), 1) AS half_even, least(abs(l_discount - 0.05), 0.03) AS low, nullif(l_linenumber, 1) AS n, l_quantity BETWEEN 10 AND 20 AS mid
FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.greatest(F.rint(F.col("l_quantity") / 4), F.lit(1.0)).alias("half_even"),
        F.least(F.abs(F.col("l_discount") - 0.05), F.lit(0.03)).alias("low"), F.nullif("l_linenumber", F.lit(1)).alias("n"),
        F.col("l_quantity").between(10, 20).alias("mid"))


@query("f10_is_distinct_from", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM nullif(left(o_orderpriority, 1), '1')")
def _(spark, sf):
    return table(spark, sf, "orders").filter(~F.nullif("o_orderstatus", F.lit("F")).eqNullSafe(
        F.nullif(F.substring("o_orderpriority", 1, 1), F.lit("1")))).select("o_orderkey")


_AGE = "CASE id % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(S.PERIODS)) + " END"
_SPANS = " ".join(f"WHEN {i} THEN {lo} + least(floor(r * {(hi or 2025) - lo + 1}), {(hi or 2025) - lo})" for i, (_, lo, hi) in enumerate(S.AGE_CLASSES))


@query("f11_year_from_class", f"""
SELECT id, CAST(CASE id % 8 {_SPANS} END AS INTEGER) AS year FROM (SELECT id, {_UNIFORM.format(k='objectid')} AS r FROM ({MEMBERS}) m) q""")
def _(spark, sf):
    m = members(spark, sf).withColumn("c", F.expr(_AGE))
    return m.select("id", S.year_from_class("c", S.hash_uniform(42, "objectid"), 2025).alias("year"))


@query("f12_time_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def _(spark, sf):
    return table(spark, sf, "events").filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-09").cast("timestamp"))).select("event_id")


@query("f13_hourly_range", """
SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 5) - INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS t FROM orders WHERE o_orderkey % 5 > 0""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("until", F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 5).cast("int")))
    return o.select("o_orderkey", F.explode(S.hourly_range("o_orderdate", "until")).alias("t"))


@query("f14_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.when') AS TIMESTAMP) AS at FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.when").try_cast("timestamp").alias("at"))


@query("f15_array_rules", """
SELECT o_custkey, len(list(DISTINCT o_orderstatus)) AS n, list_contains(list(o_orderstatus), 'P') AS has_p FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).select(
        "o_custkey", F.size("s").cast("bigint").alias("n"), F.array_contains("s", "P").alias("has_p"))


@query("f16_surrogate_id", "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus) AS id FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.surrogate_id("o_orderkey", "o_orderstatus").alias("id"))
