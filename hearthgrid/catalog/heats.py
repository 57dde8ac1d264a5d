"""Heat demand (H1 - H8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, scalar as S
from ..plans import heat as H
from ..session import spread_small
from .base import MEMBERS, WAYS, frame, members, query, table, ways
from .scalars import _AGE

_SURFACES = f"""SELECT objectid AS building_objectid, CASE o_orderkey % 3 WHEN 0 THEN 'WallSurface' WHEN 1 THEN 'RoofSurface' ELSE 'GroundSurface' END AS classname, CAST(50 + o_orderkey % 400 AS DOUBLE) AS area
 FROM orders JOIN ({MEMBERS}) m ON o_custkey = id"""
_HOMES = f"""SELECT id, objectid, ags, floor_area, CAST(1 + id % 4 AS INTEGER) AS floor_number, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 2 = 0 THEN 'SFH' ELSE 'MFH' END AS building_type, height FROM ({MEMBERS}) m"""
_PLANS = {"outer_wall": H.Refurbishment(40, 10, 0.3), "rooftop": H.Refurbishment(50, 10, 0.5), "window": H.Refurbishment(30, 5, 0.9)}


@query("h1_envelope_areas", f"""
SELECT h.objectid, round(w - floor_area * floor_number * 0.15, 6) AS wall_area, r AS roof_area, round(floor_area * floor_number * 0.15, 6) AS window_area FROM ({_HOMES}) h
LEFT JOIN (SELECT building_objectid, sum(CASE WHEN classname = 'WallSurface' THEN area END) AS w, sum(CASE WHEN classname = 'RoofSurface' THEN area END) AS r FROM ({_SURFACES}) s GROUP BY 1) a ON a.building_objectid = h.objectid WHERE building_type IS NOT NULL""")
def _(spark, sf):
    out = H.envelope_areas(frame(spark, sf, _HOMES), frame(spark, sf, _SURFACES))
    return out.select("objectid", F.round("wall_area", 6).alias("wall_area"), "roof_area", F.round("window_area", 6).alias("window_area"))


_DRAW = "CAST(('0x' || substr(md5('{seed}:' || objectid), 1, 8))::UBIGINT AS DOUBLE) / 4294967295e0"
_SPANS = " ".join(f"WHEN {i} THEN {lo} + least(floor(r * {(hi or 2025) - lo + 1}), {(hi or 2025) - lo})" for i, (_, lo, hi) in enumerate(S.AGE_CLASSES))


@query("h2_sample_construction_year", f"SELECT objectid, CAST(CASE id % 8 {_SPANS} END AS INTEGER) AS construction_year FROM (SELECT id, objectid, {_DRAW.format(seed='7:year')} AS r FROM ({MEMBERS}) m) q")
def _(spark, sf):
    return H.sample_construction_year(members(spark, sf).withColumn("construction_year", F.expr(_AGE)), 7, 2025).select("objectid", "construction_year")


def _aged(spark, sf):
    return members(spark, sf).select("objectid", "ags", (F.lit(1900) + F.col("id") % 120).cast("int").alias("construction_year"))


@query("h3_simulate_refurbishment")
def _(spark, sf):
    return H.simulate_refurbishment(_aged(spark, sf), 2025, _PLANS, 3)


_U = "CAST(('0x' || substr(md5('9:quota:{c}:' || objectid), 1, 8))::UBIGINT AS DOUBLE) / 4294967295e0"


def _quota_sql() -> str:
    parts = []
    for c, every, quota in (("outer_wall", 2, 0.3), ("rooftop", 3, 0.5), ("window", 5, 0.9)):
        parts.append(f"""{c} AS (SELECT objectid, CASE WHEN done AND rn > round_even({quota} * n, 0) THEN y ELSE y + CASE WHEN done THEN 20 ELSE 0 END END AS {c} FROM (
 SELECT objectid, y, done, n, row_number() OVER (PARTITION BY ags, done ORDER BY {_U.format(c=c)}, objectid) AS rn FROM (SELECT objectid, ags, 1900 + id % 120 AS y, id % {every} <> 0 AS done, count(*) OVER (PARTITION BY ags) AS n FROM ({MEMBERS}) m) q) p)""")
    return f"WITH {', '.join(parts)} SELECT objectid, CAST(outer_wall AS INTEGER) AS outer_wall, CAST(rooftop AS INTEGER) AS rooftop, CAST(\"window\" AS INTEGER) AS \"window\" FROM outer_wall JOIN rooftop USING (objectid) JOIN \"window\" USING (objectid)"


@query("h4_harmonize_quota", _quota_sql().replace("window AS (", '"window" AS (').replace("END AS window", 'END AS "window"'))
def _(spark, sf):
    year = (F.lit(1900) + F.col("id") % 120).cast("int")
    b = members(spark, sf).select("objectid", "ags", year.alias("construction_year"), *[
        (year + F.when(F.col("id") % k != 0, 20).otherwise(0)).cast("int").alias(c) for c, k in (("outer_wall", 2), ("rooftop", 3), ("window", 5))])
    return H.harmonize_quota(b, _PLANS, 9).select("objectid", "outer_wall", "rooftop", "window")


_KINDS = ("OuterWall", "Window", "Rooftop", "GroundFloor", "InnerWall", "Ceiling", "Floor")
_KIND = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_LAYERS = f"""SELECT p_brand AS building_type, {_KIND} AS element_name, CAST(p_partkey AS STRING) AS construction_data, 1900 AS start_year, 1910 AS end_year, l_orderkey * 10 + l_linenumber AS layer_index,
 'm' AS material_name, l_quantity / 500e0 AS thickness, 0.04e0 + l_tax AS thermal_conduc, 800 + l_quantity AS heat_capac, 500 + l_quantity * 10 AS density FROM lineitem JOIN part ON p_partkey = l_partkey"""
_SURFACE = "CASE element_name WHEN 'GroundFloor' THEN 1 / 7.7e0 + 1 / 1000e0 WHEN 'InnerWall' THEN 2 / 7.7e0 WHEN 'Ceiling' THEN 2 / 6.7e0 WHEN 'Floor' THEN 2 / 6.7e0 ELSE 1 / 7.7e0 + 1 / 25e0 END"


@query("h5_construction_resistance", f"""
SELECT construction_data, element_name, round(sum(thickness / thermal_conduc) + max({_SURFACE}), 6) AS r, element_name = 'Window' AS no_capacity FROM ({_LAYERS}) l GROUP BY 1, 2""")
def _(spark, sf):
    return H.construction_table(frame(spark, sf, _LAYERS)).select(
        "construction_data", "element_name", F.round("R", 6).alias("r"), (F.col("C") == 0).alias("no_capacity"))


@query("h5_construction_table")
def _(spark, sf):
    return H.construction_table(frame(spark, sf, _LAYERS))


# Constructions from nations: five eras for every part of two building types, standard and retrofit.
_CONS = """SELECT element_name, building_type, construction_data, start_year, end_year, 0.5e0 + era * 0.25e0 + k * 0.1e0 AS "R", 10e0 + era * 5 + k AS "C" FROM (
 SELECT n_nationkey AS era, 1850 + n_nationkey * 8 AS start_year, 1855 + n_nationkey * 8 AS end_year FROM nation) n, (
 SELECT * FROM (VALUES {rows}) v(k, element_name, building_type, construction_data)) e"""
_ROWS = []
for _i, _e in enumerate(("OuterWall", "Rooftop", "Window", "GroundFloor")):
    for _t in ("SFH", "MFH"):
        for _j, _s in enumerate(("standard", "retrofit")):
            _ROWS.append((_i + 4 * _j, _e, _t, f"tabula_de_{_s}_1_{_t}"))
_ROWS += [(_i, _e, "standard", "tabula_de_standard") for _i, _e in enumerate(("Ceiling", "Floor", "InnerWall"))]
_CONS = _CONS.format(rows=", ".join(f"({k}, '{e}', '{t}', '{d}')" for k, e, t, d in _ROWS))
_STATUS = f"""SELECT objectid, floor_area, floor_number, building_type, floor_area * 2 AS wall_area, floor_area * 1.5e0 AS roof_area, floor_area * 0.25e0 AS window_area, CAST(1860 + id % 150 AS INTEGER) AS construction_year,
 CAST(1860 + id % 150 + CASE WHEN id % 3 = 0 THEN 20 ELSE 0 END AS INTEGER) AS outer_wall, CAST(1860 + id % 150 + CASE WHEN id % 5 = 0 THEN 25 ELSE 0 END AS INTEGER) AS rooftop, CAST(1860 + id % 150 + CASE WHEN id % 2 = 0 THEN 30 ELSE 0 END AS INTEGER) AS {{w}} FROM ({_HOMES}) h WHERE building_type IS NOT NULL"""


def _rc_sql() -> str:
    def part(name, area, year, generic):
        kind = "'standard'" if generic else "building_type"
        data = "'tabula_de_standard'" if generic else f"CASE WHEN {year} = construction_year THEN 'tabula_de_standard_1_' ELSE 'tabula_de_retrofit_1_' END || building_type"
        return f"SELECT objectid, '{name}' AS element_name, {area} AS area, {year} AS yr, {kind} AS bt, {data} AS cd FROM s"
    st = "greatest(floor_number - 1, 1)"
    parts = " UNION ALL ".join([
        part("OuterWall", "wall_area", "outer_wall", False), part("Rooftop", "roof_area", "rooftop", False), part("Window", "window_area", "win", False),
        part("GroundFloor", "floor_area", "construction_year", False), part("Ceiling", f"floor_area * {st}", "construction_year", True),
        part("Floor", f"floor_area * {st}", "construction_year", True), part("InnerWall", f"floor_area * {st} * 2.5", "construction_year", True)])
    return f"""WITH s AS ({_STATUS.format(w='win')}), c AS ({_CONS}), p AS ({parts}),
m AS (SELECT p.objectid, p.element_name, p.area, c."R" AS r, c."C" AS cc, row_number() OVER (PARTITION BY p.objectid, p.element_name ORDER BY greatest(start_year - yr, yr - end_year, 0), start_year, end_year) AS rn FROM p JOIN c ON c.element_name = p.element_name AND c.building_type = bt AND c.construction_data = cd)
SELECT objectid, round(1 / sum(CASE WHEN element_name IN ('OuterWall', 'Rooftop', 'Window', 'GroundFloor') THEN area * 0.9 / r END), 9) AS resistance, round(sum(cc * area * 0.9), 4) AS capacitance FROM m WHERE rn = 1 GROUP BY objectid"""


@query("h6_building_rc", _rc_sql())
def _(spark, sf):
    cons = frame(spark, sf, _CONS.replace('"R"', "R").replace('"C"', "C"))
    status = spread_small(frame(spark, sf, _STATUS.format(w="win"))).withColumnRenamed("win", "window")
    return H.building_rc(status, cons, 0.9).select("objectid", F.round("resistance", 9).alias("resistance"), F.round("capacitance", 4).alias("capacitance"))


# Buildings are linked to the series of one user; user 0 .. n have hourly values.
_RC = f"SELECT objectid AS building_objectid, 0.002e0 + (id % 50) * 0.0001e0 AS resistance, id FROM ({MEMBERS}) m"
_SPAN = "value < 20 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-30'"
_DEMAND = f"""SELECT building_objectid, round(count(value) / resistance * (20 - avg(value)) / 1000, 9) AS demand_kwh, round(max((20 - value) / resistance), 4) AS pmax
FROM ({_RC}) b JOIN (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0) m ON m.user_id = CAST(floor(b.id / 10e0) AS BIGINT) JOIN (SELECT user_id, ts, value FROM events WHERE {_SPAN}) e ON e.user_id = m.user_id GROUP BY building_objectid, resistance"""


def _demand_inputs(spark, sf):
    e = table(spark, sf, "events")
    rc = frame(spark, sf, _RC)
    links = rc.select(F.col("building_objectid").alias("bld_objectid"), F.floor(F.col("id") / 10).alias("ts_metadata_id"))
    meta = e.select(F.col("user_id").alias("id")).distinct().withColumn("name", F.when(F.col("id") % 3 != 0, H.TEMPERATURE).otherwise("wind"))
    data = e.select(F.col("user_id").alias("ts_metadata_id"), F.col("ts").alias("time"), "value")
    return rc.select("building_objectid", "resistance"), links, meta, data


def demand(spark, sf, direct: bool = False):
    fn = H.annual_heat_demand_direct if direct else H.annual_heat_demand
    out = fn(*_demand_inputs(spark, sf), 20.0, "2024-01-01", "2024-01-30")
    return out.select("building_objectid", F.round("demand_kwh", 9).alias("demand_kwh"), F.round("pmax", 4).alias("pmax"))


@query("h7_annual_heat_demand", _DEMAND)
def _(spark, sf):
    return demand(spark, sf)


@query("h7_annual_heat_demand_direct", _DEMAND)
def _(spark, sf):
    return demand(spark, sf, direct=True)


@query("h8_linear_heat_density", f"""
WITH w AS (SELECT id, ags, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len FROM ({WAYS}) q), d AS (SELECT CAST(m.id * 3 AS VARCHAR) AS street_id, sum(floor_area * 0.5) AS t FROM ({MEMBERS}) m GROUP BY 1)
SELECT w.id AS street_id, coalesce(t, 0) AS total_heat_demand, round(CASE WHEN len > 0 THEN coalesce(t, 0) / len ELSE 0 END, 6) AS linear_heat_density FROM w LEFT JOIN d ON d.street_id = w.id""")
def _(spark, sf):
    m = members(spark, sf)
    links = m.select(F.col("id").alias("building_id"), (F.col("id") * 3).cast("string").alias("street_id"))
    need = m.select(F.col("id").alias("building_objectid"), (F.col("floor_area") * 0.5).alias("demand_kwh"))
    w = ways(spark, sf).withColumn("length_geo", G.length("geom")).drop("geom")
    return H.linear_heat_density(w, links, need).select("street_id", "total_heat_demand", F.round("linear_heat_density", 6).alias("linear_heat_density"))
