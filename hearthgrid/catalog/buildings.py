"""Building enrichment (B1 - B20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, scalar as S
from ..operators import spatial
from ..plans import buildings as B, features as FE
from ..session import cut_lineage
from .base import (AREAS, CELLS, MEMBERS, POSTCODES, STATIONS, areas, cells, frame, members, outlines, postcodes, query, stations, table)
from .scalars import _UNIFORM, use_codes


def _store(spark, sf):
    """Members as features, attribute rows and addresses."""
    m = members(spark, sf)
    f = m.select("id", F.when(F.col("id") % 9 == 0, 902).otherwise(901).alias("objectclass_id"), "objectid")
    none = {"val_string": "string", "val_int": "bigint", "val_double": "double", "val_address_id": "bigint"}

    def row(name, **given):
        return F.struct(F.lit(name).alias("name"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    p = m.select(F.col("id").alias("feature_id"), F.explode(F.array(
        row("function", val_string=F.col("building_use_id")), row("Gemeindeschluessel", val_string=F.col("ags").cast("string")),
        row("storeysAboveGround", val_int=F.col("storeysaboveground")), row("value", val_double=F.col("height")),
        row("address", val_address_id=F.col("id")))).alias("p")).select("feature_id", "p.*")
    a = m.select("id", F.concat(F.lit("Weg "), F.col("id").cast("string")).alias("street"), F.lit("80331").alias("zip_code"), F.lit("M").alias("city"),
                 F.lit("DE").alias("country"), F.lit("BY").alias("state"))
    return f, p, a


@query("b1_flatten_city_buildings", f"""
SELECT id AS feature_id, objectid, building_use_id AS building_function_code, CAST(ags AS VARCHAR) AS gemeindeschluessel, storeysaboveground, height, 'Weg' AS street, CAST(id AS VARCHAR) AS house_number, left(CAST(ags AS VARCHAR), 2) AS ags_id
FROM ({MEMBERS}) m WHERE id % 9 <> 0 AND objectid LIKE 'Customer#%' AND ags IN (10, 11, 12)""")
def _(spark, sf):
    out = FE.flatten_city_buildings(*_store(spark, sf), ags=["10", "11", "12"], object_prefix="Customer#")
    return out.select("feature_id", "objectid", "building_function_code", "gemeindeschluessel", "storeysaboveground", "height", "street", "house_number", "ags_id")


def _surface_store(spark, sf):
    """Each member is a solid naming two children, each the geometry of a wall and of a ground surface."""
    m = outlines(spark, sf)
    k = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("i")) for i, c in ((0, 901), (1, 709), (2, 710))])).alias("k")
    rows = m.select("id", "ags", "objectid", "geom", "half_w", k).withColumn("fid", F.col("id") * 3 + F.col("k.i"))
    f = rows.select(F.col("fid").alias("id"), F.col("k.c").alias("objectclass_id"), F.when(F.col("k.i") == 0, F.col("objectid")).otherwise(
        F.concat("objectid", F.lit("_"), F.col("k.i").cast("string"))).alias("objectid"))
    child = F.when(F.col("k.i") == 0, F.format_string('{"objectId":"c%d_1"},{"objectId":"c%d_2"},{"x":1}', "id", "id")).otherwise(
        F.format_string('{"objectId":"c%d_%d"}', "id", "k.i"))
    g = rows.select(F.col("fid").alias("id"), F.col("fid").alias("feature_id"), F.concat(F.lit('{"children":['), child, F.lit("]}")).alias("geometry_properties"),
                    F.col("geom").alias("geometry"))
    p = rows.filter("k.i = 0").select(F.col("fid").alias("feature_id"), F.lit("Gemeindeschluessel").alias("name"), F.col("ags").cast("string").alias("val_string")).unionByName(
        rows.filter("k.i > 0").select(F.col("fid").alias("feature_id"), F.lit("Flaeche").alias("name"), F.when(F.col("id") % 3 > 0, (F.col("half_w") * 4).cast("string")).alias("val_string")))
    classes = table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, 709).otherwise(710).alias("id"), F.when(F.col("r_regionkey") == 0, "WallSurface").otherwise("GroundSurface").alias("classname")).distinct()
    return f, g, p, classes


@query("b2_link_surfaces", f"""
SELECT objectid AS building_objectid, 708 + i AS objectclass_id, CASE i WHEN 1 THEN 'WallSurface' ELSE 'GroundSurface' END AS classname, CASE WHEN id % 3 > 0 THEN half_w * 4 END AS area, CAST(ags AS VARCHAR) AS gemeindeschluessel, 4 * half_w * half_h AS flat
FROM ({MEMBERS}) m, (SELECT unnest([1, 2]) AS i)""")
def _(spark, sf):
    out = FE.link_surfaces(*_surface_store(spark, sf))
    return out.select("building_objectid", "objectclass_id", "classname", "area", "gemeindeschluessel", G.area("geom").alias("flat"))


@query("b3_building_view", f"SELECT objectid, CASE WHEN id % 3 > 0 THEN half_w * 4 END AS groundsurface_flaeche, x AS px, y AS py, 1 AS parts FROM ({MEMBERS}) m")
def _(spark, sf):
    view = FE.building_view(members(spark, sf).select("objectid"), FE.link_surfaces(*_surface_store(spark, sf)))
    return view.select("objectid", "groundsurface_flaeche", F.round("centroid.x", 6).alias("px"), F.round("centroid.y", 6).alias("py"), F.size("geom").alias("parts"))


@query("b4_make_grid", f"""
SELECT DISTINCT r || 'N' || CAST(gy AS VARCHAR) || 'E' || CAST(gx AS VARCHAR) AS id, CAST(gx + s / 2 AS INTEGER) AS x_mp, CAST(gy + s / 2 AS INTEGER) AS y_mp, 'DE_Grid_ETRS89_LAEA_' || r AS name, CAST(s AS INTEGER) AS resolution_meters
FROM (SELECT *, unnest(generate_series(CAST(floor(ay1 / s) AS BIGINT), CAST(ceil(ay2 / s) AS BIGINT) - 1)) * s AS gy FROM (SELECT ax1, ax2, ay1, ay2, r, s, unnest(generate_series(CAST(floor(ax1 / s) AS BIGINT), CAST(ceil(ax2 / s) AS BIGINT) - 1)) * s AS gx
 FROM ({AREAS}) a, (VALUES ('200m', 200), ('1km', 1000)) v(r, s)) q) p
WHERE gx + s / 2 BETWEEN ax1 AND ax2 AND gy + s / 2 BETWEEN ay1 AND ay2""")
def _(spark, sf):
    return B.make_grid(areas(spark, sf), "area_geom", ["200m", "1km", "3ft"]).select("id", "x_mp", "y_mp", "name", "resolution_meters")


@query("b5_fill_surface_area", f"SELECT id, CASE WHEN id % 3 = 0 THEN round(2 * half_w * height, 3) ELSE half_w END AS area, id % 3 = 0 AS is_synthetic FROM ({MEMBERS}) m")
def _(spark, sf):
    x, y, w, z = (F.col(c) for c in ("x", "y", "half_w", "height"))
    wall = F.array(F.array(F.array(*[G.make_point(a, y, b) for a, b in ((x - w, F.lit(0.0)), (x + w, F.lit(0.0)), (x + w, z), (x - w, z), (x - w, F.lit(0.0)))])))
    s = members(spark, sf).select("id", wall.alias("geom"), F.when(F.col("id") % 3 > 0, F.col("half_w")).alias("area"))
    return B.fill_surface_area(s).select("id", "area", "is_synthetic")


@query("b6_impute_floors", f"""
WITH k AS (SELECT *, CASE WHEN storeysaboveground <> 0 AND NOT height < 2.0 * storeysaboveground AND NOT height > 6.0 * storeysaboveground THEN storeysaboveground END AS fl FROM ({MEMBERS}) m),
u AS (SELECT ags, building_use_id, quantile_cont(height / fl, 0.5) AS med FROM k WHERE fl > 0 GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT id, CAST(coalesce(fl, CASE WHEN med IS NOT NULL THEN greatest(round_even(height / med, 0), 1) END, greatest(round_even(height / CASE WHEN building_use = 'Residential' THEN 3.0 ELSE 3.5 END, 0), 1)) AS INTEGER) AS floor_number
FROM k LEFT JOIN u ON k.ags = u.ags AND k.building_use_id = u.building_use_id""")
def _(spark, sf):
    return B.impute_floors(members(spark, sf)).select("id", "floor_number")


@query("b7_enrich_grid", f"""
SELECT m.cx, m.cy, einwohner, vor1919, CASE WHEN m.cx % 2 = 0 THEN freiefh END AS freiefh FROM (SELECT DISTINCT cx, cy FROM ({MEMBERS}) q) m LEFT JOIN ({CELLS}) c ON m.cx = c.cx AND m.cy = c.cy""")
def _(spark, sf):
    c = cells(spark, sf).withColumnsRenamed({"cx": "x_mp_1km", "cy": "y_mp_1km"})
    grid = members(spark, sf).select(F.col("cx").alias("x_mp"), F.col("cy").alias("y_mp")).distinct()
    out = B.enrich_grid(grid, {"a": c.select("x_mp_1km", "y_mp_1km", "einwohner"), "b": c.select("x_mp_1km", "y_mp_1km", "vor1919"),
                               "c": c.filter("x_mp_1km % 2 = 0").select("x_mp_1km", "y_mp_1km", "freiefh")}, "1km")
    return out.withColumnsRenamed({"x_mp": "cx", "y_mp": "cy"})


_OCC = f"""SELECT m.id, m.ags, m.cx, m.cy, CASE WHEN c.cx IS NULL OR building_use <> 'Residential' THEN NULL WHEN t > 0 THEN CAST(greatest(round_even(floor_area * height / t * einwohner, 0), 1) AS INTEGER) ELSE 0 END AS occupants
FROM ({MEMBERS}) m LEFT JOIN ({CELLS}) c ON m.cx = c.cx AND m.cy = c.cy LEFT JOIN (SELECT ags, cx, cy, sum(floor_area * height) AS t FROM ({MEMBERS}) q WHERE building_use = 'Residential' GROUP BY 1, 2, 3) s ON s.ags = m.ags AND s.cx = m.cx AND s.cy = m.cy"""


@query("b8_allocate_occupants", f"SELECT id, occupants FROM ({_OCC}) o")
def _(spark, sf):
    return B.allocate_occupants(members(spark, sf), cells(spark, sf), ["cx", "cy"]).select("id", "occupants")


@query("b9_derive_households", f"""
SELECT o.id, CASE WHEN occupants IS NULL THEN NULL ELSE CAST(greatest(round_even(occupants / durchschnhhgroesse, 0), 1) AS INTEGER) END AS households FROM ({_OCC}) o LEFT JOIN ({CELLS}) c ON o.cx = c.cx AND o.cy = c.cy""")
def _(spark, sf):
    c = cells(spark, sf)
    return B.derive_households(B.allocate_occupants(members(spark, sf), c, ["cx", "cy"]), c, ["cx", "cy"]).select("id", "households")


_W = [f"coalesce({w}, 0)" for w in B.PERIOD_COLUMNS]
_TOTAL = "(" + " + ".join(_W) + ")"
_CHOICE = "CASE WHEN {t} <= 0 OR {t} IS NULL THEN NULL ".format(t="wt") + " ".join(
    f"WHEN r <= ({' + '.join(B.PERIOD_COLUMNS[:i + 1])}) / wt THEN '{S.PERIODS[i]}'" for i in range(7)) + f" ELSE '{S.PERIODS[7]}' END"


@query("b10_assign_construction_period", f"""
WITH c AS (SELECT *, {_TOTAL} AS wt FROM ({CELLS}) z), m AS (SELECT id, x, y, cx, cy, {_UNIFORM.format(k='objectid')} AS r FROM ({MEMBERS}) q),
own AS (SELECT m.id, m.x, m.y, m.r, {_CHOICE} AS label FROM m LEFT JOIN c ON m.cx = c.cx AND m.cy = c.cy),
near AS (SELECT own.id, own.r, c.*, row_number() OVER (PARTITION BY own.id ORDER BY sqrt(power(greatest(c.cx * 500e0 - x, x - c.cx * 500e0 - 500, 0), 2) + power(greatest(c.cy * 500e0 - y, y - c.cy * 500e0 - 500, 0), 2)), c.cx, c.cy) AS rn FROM own, c WHERE label IS NULL AND wt > 0)
SELECT own.id, coalesce(own.label, n.label) AS construction_year FROM own LEFT JOIN (SELECT id, {_CHOICE} AS label FROM near WHERE rn = 1) n ON n.id = own.id""")
def _(spark, sf):
    c = cells(spark, sf).withColumns({
        "xmin": F.col("cx") * 500.0, "xmax": F.col("cx") * 500.0 + 500, "ymin": F.col("cy") * 500.0, "ymax": F.col("cy") * 500.0 + 500})
    return B.assign_construction_period(members(spark, sf), cut_lineage(c), ["cx", "cy"], 42).select("id", "construction_year")


@query("b11_assign_postcode", f"SELECT id, CAST(plz AS INTEGER) AS postcode FROM ({MEMBERS}) m LEFT JOIN ({POSTCODES}) p ON x > px1 AND x < px2 AND y > py1 AND y < py2")
def _(spark, sf):
    return B.assign_postcode(outlines(spark, sf), postcodes(spark, sf)).select("id", "postcode")


_BOXD = "sqrt(power(greatest(sx - x - half_w, x - half_w - sx, 0), 2) + power(greatest(sy - y - half_h, y - half_h - sy, 0), 2))"


@query("b12_nearest_series", f"""
SELECT bld_objectid, ts_metadata_id, ts_metadata_name, round(d, 6) AS dist FROM (SELECT objectid AS bld_objectid, sid AS ts_metadata_id, 'v' || CAST(s_nationkey % 3 AS VARCHAR) AS ts_metadata_name, {_BOXD} AS d,
 row_number() OVER (PARTITION BY objectid, s_nationkey % 3 ORDER BY {_BOXD}, sid) AS rn FROM ({MEMBERS}) m, ({STATIONS}) s WHERE s_nationkey % 3 < 2) q WHERE rn = 1""")
def _(spark, sf):
    s = stations(spark, sf).select(F.col("sid").alias("ts_metadata_id"), F.concat(F.lit("v"), (F.col("s_nationkey") % 3).cast("string")).alias("ts_metadata_name"),
                                   G.make_point("sx", "sy").alias("ts_geom"))
    return B.nearest_series(outlines(spark, sf).select("objectid", "geom", "centroid"), s, ["v0", "v1"]).select(
        "bld_objectid", "ts_metadata_id", "ts_metadata_name", F.round("dist", 6).alias("dist"))


# Typed members: floors, and neighbours within 25 units of the outline.
_REACH = 25.0
_TYPED = f"SELECT id, objectid, x, y, half_w, half_h, ags, cx, cy, building_use, floor_area * 4 - 20 AS floor_area, height, CAST(1 + id % 4 AS INTEGER) AS floor_number FROM ({MEMBERS}) m"
_TGAP = "sqrt(power(greatest(a.x - a.half_w - b.x - b.half_w, b.x - b.half_w - a.x - a.half_w, 0), 2) + power(greatest(a.y - a.half_h - b.y - b.half_h, b.y - b.half_h - a.y - a.half_h, 0), 2))"
_TOUCH = f"""SELECT a.id AS a_id, b.id AS b_id, a.floor_area AS a_area, b.floor_area AS b_area, a.floor_number AS a_floors, b.floor_number AS b_floors FROM ({_TYPED}) a JOIN ({_TYPED}) b ON a.id <> b.id AND a.ags = b.ags
 AND a.building_use = 'Residential' AND b.building_use = 'Residential' AND a.x BETWEEN b.x - 60 AND b.x + 60 AND {_TGAP} <= {_REACH}"""


def _typed(spark, sf):
    from ..session import spread_small

    t = spread_small(frame(spark, sf, _TYPED))
    return t.withColumns({"geom": G.make_box(F.col("x") - F.col("half_w"), F.col("y") - F.col("half_h"), F.col("x") + F.col("half_w"), F.col("y") + F.col("half_h"))})


def _with_neighbours(spark, sf):
    t = _typed(spark, sf)
    n = cut_lineage(B.touching_neighbours(t, _REACH))
    return B.neighbour_counts(t, n), n


@query("b13_touching_neighbours", f"SELECT a_id, b_id, a_area, b_area FROM ({_TOUCH}) t")
def _(spark, sf):
    return B.touching_neighbours(_typed(spark, sf), _REACH).select("a_id", "b_id", F.col("a_floor_area").alias("a_area"), F.col("b_floor_area").alias("b_area"))


def _spread_sql(label: str, start: str, rule: str, member: str, edge: str = "true") -> str:
    """Seeds by rule, then every open member connected to a seed."""
    return f"""
WITH RECURSIVE touch AS MATERIALIZED ({_TOUCH}), b AS MATERIALIZED (SELECT t.*, {start} AS t0, coalesce(n, 0) AS nc, coalesce(tw, 0) AS twin FROM ({_TYPED}) t LEFT JOIN (SELECT a_id, count(*) AS n, count(CASE WHEN abs(a_area - b_area) / greatest(a_area, b_area) < 0.2 THEN 1 END) AS tw FROM touch GROUP BY 1) c ON c.a_id = t.id),
s AS MATERIALIZED (SELECT *, CASE WHEN building_use = 'Residential' AND t0 IS NULL AND ({rule}) THEN '{label}' ELSE t0 END AS t1 FROM b),
o AS MATERIALIZED (SELECT id FROM s WHERE building_use = 'Residential' AND (t1 = '{label}' OR (t1 IS NULL AND {member}))),
e AS MATERIALIZED (SELECT a_id, b_id FROM touch WHERE a_id IN (SELECT id FROM o) AND b_id IN (SELECT id FROM o) AND {edge}),
r AS (SELECT id FROM s WHERE t1 = '{label}' UNION SELECT b_id FROM e JOIN r ON e.a_id = r.id)
SELECT s.id, CASE WHEN r.id IS NOT NULL THEN '{label}' ELSE t1 END AS building_type FROM s LEFT JOIN (SELECT DISTINCT id FROM r) r ON r.id = s.id"""


_RATIO = "a_floors = b_floors AND abs(a_area - b_area) / greatest(a_area, b_area) < 0.2"


@query("b14_classify_type_ab", _spread_sql("AB", "NULL", "floor_number >= 4 OR floor_area > 1500 OR (floor_number >= 3 AND nc >= 3)", "true"))
def _(spark, sf):
    b, n = _with_neighbours(spark, sf)
    return B.classify_type_ab(b.withColumn("building_type", F.lit(None).cast("string")), n).select("id", "building_type")


_PRE = "CASE WHEN t.id % 7 = 0 AND t.building_use = 'Residential' THEN 'AB' END"


def _pre(b):
    return b.withColumn("building_type", F.when((F.col("id") % 7 == 0) & (F.col("building_use") == "Residential"), "AB"))


@query("b15_classify_type_sfh", _spread_sql("SFH", _PRE, "(floor_area < 350 AND floor_number <= 3 AND nc = 0) OR (floor_area < 200 AND floor_number <= 2 AND nc < 2)", "floor_area < 100 AND floor_number <= 2"))
def _(spark, sf):
    b, n = _with_neighbours(spark, sf)
    return B.classify_type_sfh(_pre(b), n).select("id", "building_type")


@query("b16_classify_type_th", _spread_sql("TH", _PRE, "floor_area BETWEEN 70 AND 150 AND floor_number BETWEEN 2 AND 3 AND nc BETWEEN 1 AND 2 AND twin > 0", "floor_area BETWEEN 70 AND 150 AND floor_number BETWEEN 2 AND 3", _RATIO))
def _(spark, sf):
    b, n = _with_neighbours(spark, sf)
    return B.classify_type_th(_pre(b), n).select("id", "building_type")


@query("b17_classify_type_mfh", _spread_sql("MFH", _PRE, "floor_number BETWEEN 2 AND 3 OR (floor_area > 150 AND nc BETWEEN 1 AND 3)", "true"))
def _(spark, sf):
    b, n = _with_neighbours(spark, sf)
    return B.classify_type_mfh(_pre(b), n).select("id", "building_type")


_STATE = f"""SELECT id, objectid, ags, cx, cy, building_use, floor_area, height, CASE WHEN building_use <> 'Residential' THEN NULL WHEN segment = 'AUTOMOBILE' THEN 'AB' WHEN segment = 'BUILDING' THEN 'MFH' WHEN segment = 'FURNITURE' THEN 'TH' WHEN segment = 'HOUSEHOLD' THEN 'SFH' END AS building_type,
 CAST(1 + id % 6 AS INTEGER) AS households, CAST(1 + id % 5 AS INTEGER) AS occupants, id % 3 AS neighbour_count FROM ({MEMBERS}) m"""


@query("b18_fix_types", f"""
SELECT id, CASE WHEN t IN ('MFH', 'AB') AND households = 1 THEN CASE WHEN neighbour_count = 0 THEN 'SFH' ELSE 'TH' END WHEN t IN ('SFH', 'TH') AND households BETWEEN 2 AND 4 THEN 'MFH' WHEN t IN ('SFH', 'TH') AND households >= 5 THEN 'AB' ELSE t END AS building_type
FROM (SELECT *, CASE WHEN building_use = 'Residential' AND building_type IS NULL THEN 'AB' ELSE building_type END AS t FROM ({_STATE}) s) q""")
def _(spark, sf):
    return B.fix_types(frame(spark, sf, _STATE)).select("id", "building_type")


# The rebalance on coarse cells (1000), so that cells hold enough buildings of each type.
_BIG = f"SELECT id, objectid, ags, CAST(floor(cx / 2e0) AS BIGINT) AS gx, CAST(floor(cy / 2e0) AS BIGINT) AS gy, building_use, floor_area, height, coalesce(building_type, CASE WHEN building_use = 'Residential' THEN 'SFH' END) AS building_type, households, occupants FROM ({_STATE}) s"
_TARGETS = f"""SELECT CAST(floor(cx / 2e0) AS BIGINT) AS gx, CAST(floor(cy / 2e0) AS BIGINT) AS gy, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in B.TYPE_COLUMNS)} FROM ({CELLS}) c GROUP BY 1, 2"""
_GOALS = {"AB": "mfh_13undmehrwohnungen + mfh_7bis12wohnungen", "MFH": "mfh_3bis6wohnungen + freist_zfh", "TH": "efh_reihenhaus + zfh_reihenhaus + zfh_dhh + efh_dhh"}
_POOLS = {"AB": "count(CASE WHEN building_type = 'MFH' AND households > 1 THEN 1 END)", "MFH": "count(CASE WHEN building_type = 'TH' THEN 1 END)", "TH": "0"}
_MOVES = {
    "AB": """CASE WHEN building_type = 'AB' AND adj < 0 AND rn <= -adj THEN 'MFH' WHEN building_type = 'MFH' AND households > 1 AND adj > 0 AND rn <= adj THEN 'AB' WHEN building_type = 'TH' AND adj > 0 AND adj >= pool AND rn <= adj - pool THEN 'AB' END,
 CASE WHEN building_type = 'TH' AND rn >= greatest(0, adj - pool) THEN households ELSE greatest(households, 2) END""",
    "MFH": """CASE WHEN building_type = 'MFH' AND households <= 2 AND adj < 0 AND rn <= -adj THEN 'TH' WHEN building_type = 'TH' AND adj > 0 AND rn <= adj THEN 'MFH' WHEN building_type = 'SFH' AND adj > pool AND adj > 0 AND rn <= greatest(0, adj - pool) THEN 'MFH' END,
 CASE WHEN building_type = 'MFH' THEN households ELSE greatest(households, 2) END""",
    "TH": """CASE WHEN building_type = 'TH' AND adj < 0 AND rn <= -adj THEN 'SFH' WHEN building_type = 'SFH' AND adj > 0 AND rn <= adj THEN 'TH' END,
 CASE WHEN building_type = 'TH' THEN 1 ELSE households END"""}
_ALLOWED = {"AB": "(building_type = 'MFH' AND households <= 1)", "MFH": "(building_type = 'MFH' AND households > 2)", "TH": "false"}


def _rebalance_sql(stage: str) -> str:
    new_type, new_homes = _MOVES[stage].split(",\n ")
    return f"""
WITH b AS ({_BIG}), t AS (SELECT gx, gy, {_GOALS[stage]} AS goal, {" + ".join(B.TYPE_COLUMNS)} AS total FROM ({_TARGETS}) z),
cur AS (SELECT ags, gx, gy, count(CASE WHEN building_type = '{stage}' THEN 1 END) AS have, {_POOLS[stage]} AS pool, count(*) AS n FROM b WHERE building_use = 'Residential' GROUP BY 1, 2, 3),
p AS (SELECT ags, cur.gx, cur.gy, pool, (2 * goal * n + total) // (2 * total) - have AS adj FROM cur JOIN t ON t.gx = cur.gx AND t.gy = cur.gy WHERE total > 0),
r AS (SELECT b.*, pool, adj, row_number() OVER (PARTITION BY b.ags, b.gx, b.gy, building_type, {_ALLOWED[stage]} ORDER BY CASE WHEN adj > 0 THEN -floor_area * height ELSE floor_area * height END, objectid) AS rn
 FROM b JOIN p ON p.ags = b.ags AND p.gx = b.gx AND p.gy = b.gy WHERE building_use = 'Residential'),
c AS (SELECT id, occupants, {new_type} AS nt, {new_homes} AS nh FROM r)
SELECT b.id, coalesce(nt, b.building_type) AS building_type, CASE WHEN nt IS NULL THEN b.households ELSE nh END AS households, CASE WHEN nt IS NULL THEN b.occupants ELSE greatest(c.occupants, nh, CASE WHEN nt = 'AB' THEN 2 ELSE 1 END) END AS occupants
FROM b LEFT JOIN c ON c.id = b.id"""


def _rebalance(stage):
    def run(spark, sf):
        b = frame(spark, sf, _BIG)
        targets = B.census_targets(frame(spark, sf, _TARGETS), ["gx", "gy"])
        return B.rebalance(b, targets, stage, ["gx", "gy"]).select("id", "building_type", "households", "occupants")
    return run


for _name in ("AB", "MFH", "TH"):
    query(f"b19_rebalance_{_name.lower()}", _rebalance_sql(_name))(_rebalance(_name))


@query("b20_enrich_buildings")
def _(spark, sf):
    m = outlines(spark, sf)
    view = m.select(F.col("id").alias("feature_id"), "objectid", "ags", F.col("building_use_id").alias("building_function_code"), "height", "storeysaboveground",
                    F.lit("Weg").alias("street"), F.lit("1").alias("house_number"), "geom", "centroid")
    ground = m.select(F.col("objectid").alias("building_objectid"), F.lit(710).alias("objectclass_id"), F.col("floor_area").alias("area"),
                      F.lit(None).cast("array<array<array<struct<x:double,y:double,z:double>>>>").alias("geom"))
    census = cells(spark, sf).withColumns({"x_mp": (F.col("cx") * 500 + 250).cast("int"), "y_mp": (F.col("cy") * 500 + 250).cast("int")}).drop("cx", "cy")
    out = B.enrich_buildings(view, ground, census, postcodes(spark, sf), use_codes(spark, sf), 42, 3035, 500)
    return out.select("id", "objectid", "ags", "building_use", "building_type", "floor_number", "occupants", "households", "construction_year", "postcode")
