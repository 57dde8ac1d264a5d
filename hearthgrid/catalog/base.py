"""Registry of example queries and the frames they share.

The driver tables have no geometry, so buildings, ways, cells and series are derived from their
keys. The texts below run unchanged in Spark and in the oracle engine; they only shape inputs. What
a query tests is computed by the library on one side and by independent SQL on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..session import spread_small

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run a shared text on the driver tables."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def spread(key: str, a: int, b: int, m: int) -> str:
    """Scattered integer in [0, 5000) from a key."""
    return f"(({key} % 1000003) * {a} + (({key} % {m}) * ({key} % {m}) % 4999) * {b}) % 5000"


def position(key: str) -> tuple[str, str]:
    """Tiles of 5000 x 5000 units with 5000 keys each: the density does not change with the data."""
    x = f"CAST({spread(key, 7919, 31, 1009)} + 5000 * CAST(floor({key} / 5000e0) AS BIGINT) AS DOUBLE)"
    return x, f"CAST({spread(key, 10473, 57, 997)} AS DOUBLE)"


_CX, _CY = position("c_custkey")
_SX, _SY = position("s_suppkey")
_OX, _OY = position("o_orderkey")

# Buildings as points, with a municipality (tiles of 2500) and a cell (500).
MEMBERS = f"""
SELECT id, x, y, floor_area, height, storeysaboveground, building_use, building_use_id, objectid, segment,
       CAST(floor(x / 2500) * 2 + floor(y / 2500) + 10 AS BIGINT) AS ags,
       CAST(floor(x / 500) AS BIGINT) AS cx, CAST(floor(y / 500) AS BIGINT) AS cy, half_w, half_h, balance
FROM (SELECT c_custkey AS id, {_CX} AS x, {_CY} AS y,
       CAST(10 + (c_custkey * 13) % 400 AS DOUBLE) AS floor_area,
       3 + ((c_custkey * 7) % 60) / 4e0 AS height,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(1 + c_custkey % 6 AS BIGINT) END AS storeysaboveground,
       CASE c_custkey % 5 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Public' ELSE 'Residential' END AS building_use,
       CASE c_custkey % 5 WHEN 0 THEN '31001_2010' WHEN 1 THEN '31001_3020' ELSE '31001_' || CAST(1000 + 10 * (c_custkey % 3) AS STRING) END AS building_use_id,
       c_name AS objectid, c_mktsegment AS segment, CAST(1 + c_custkey % 9 AS DOUBLE) AS half_w,
       CAST(1 + c_custkey % 7 AS DOUBLE) AS half_h, c_acctbal AS balance FROM customer) q"""

# Stations (few points).
STATIONS = f"""
SELECT s_suppkey AS sid, {_SX} AS sx, {_SY} AS sy, s_nationkey, s_acctbal FROM supplier"""

# Census cells with population, household size, period and type counts.
_PERIODS = ("vor1919", "a1919bis1948", "a1949bis1978", "a1979bis1990", "a1991bis2000", "a2001bis2010", "a2011bis2019", "a2020undspaeter")
_TYPES = ("freiefh", "efh_dhh", "efh_reihenhaus", "freist_zfh", "zfh_dhh", "zfh_reihenhaus", "mfh_3bis6wohnungen", "mfh_7bis12wohnungen", "mfh_13undmehrwohnungen")
CELLS = f"""
SELECT cx, cy, CASE WHEN (cx * 7 + cy) % 11 = 0 THEN NULL ELSE count(*) * 3 END AS einwohner,
       CASE WHEN (cx + cy * 3) % 13 = 0 THEN NULL ELSE 1 + ((cx * 5 + cy) % 9) / 4e0 END AS durchschnhhgroesse,
       {", ".join(f"CAST(CASE WHEN (cx + cy) % 3 = 0 THEN 0 ELSE count(CASE WHEN o_orderkey % 8 = {i} THEN 1 END) END AS DOUBLE) AS {n}" for i, n in enumerate(_PERIODS))},
       {", ".join(f"CAST(count(CASE WHEN o_orderkey % 9 = {i} THEN 1 END) AS BIGINT) AS {n}" for i, n in enumerate(_TYPES))}
FROM ({MEMBERS}) m JOIN orders ON o_custkey = id GROUP BY cx, cy"""

# Ways: one short segment per order.
WAYS = f"""
SELECT id, x1, y1, x1 + (o % 81) - 40 AS x2, y1 + (o % 61) - 30 + (CASE WHEN o % 81 = 40 AND o % 61 = 30 THEN 1 ELSE 0 END) AS y2,
       CAST(floor(x1 / 2500) * 2 + floor(y1 / 2500) + 10 AS BIGINT) AS ags, klasse, objektart, o
FROM (SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS o, {_OX} AS x1, {_OY} AS y1, o_orderpriority AS klasse, o_orderstatus AS objektart FROM orders) q"""

# Ways on a lattice of 50 units, so that ends meet.
LATTICE = f"""
SELECT id, o, x1, y1, x1 + 50 * ((o % 3) - 1) AS x2, y1 + 50 * (CAST(floor(o / 3e0) AS BIGINT) % 3 - 1) AS y2, 1 AS ags, klasse, objektart
FROM (SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS o, 50 * floor(({_OX}) / 50) AS x1, 50 * floor(({_OY}) / 50) AS y1,
             o_orderpriority AS klasse, o_orderstatus AS objektart FROM orders) q
"""

# Rectangles that tile the plane: municipalities (2500) and postcodes (1250 x 1000).
AREAS = f"""
SELECT DISTINCT ags, floor(x / 2500) * 2500 AS ax1, floor(y / 2500) * 2500 AS ay1,
       floor(x / 2500) * 2500 + 2500 AS ax2, floor(y / 2500) * 2500 + 2500 AS ay2 FROM ({MEMBERS}) m"""
POSTCODES = f"""
SELECT DISTINCT CAST(10000 + floor(x / 1250) * 10 + floor(y / 1000) AS BIGINT) AS plz, floor(x / 1250) * 1250 AS px1, floor(y / 1000) * 1000 AS py1,
       floor(x / 1250) * 1250 + 1250 AS px2, floor(y / 1000) * 1000 + 1000 AS py2 FROM ({MEMBERS}) m"""

# Zones: concave polygons with a hole, turned by angles of whole-number triangles; one vertex per row, rings closed.
_TURN = ("CASE s_suppkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0e0 ELSE -0.8e0 END", "CASE s_suppkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 1e0 ELSE 0.6e0 END")
_RINGS = (((-4, -4), (4, -4), (4, 4), (1, 4), (1, 0), (-2, 1), (-2, 4), (-4, 3), (-4, -4)), ((-2, -3), (-2, -1), (3, -1), (2, -3), (-2, -3)))
ZONES = f"""
SELECT s_suppkey AS zid, ring, k, {_SX} + 0.37e0 + r * (c * u - s * v) AS vx, {_SY} + 0.41e0 + r * (s * u + c * v) AS vy
FROM (SELECT *, {_TURN[0]} AS c, {_TURN[1]} AS s, 20e0 + s_suppkey % 7 * 15 AS r FROM supplier) z
CROSS JOIN (VALUES {", ".join(f"({i}, {k}, CAST({u} AS DOUBLE), CAST({v} AS DOUBLE))" for i, ring in enumerate(_RINGS) for k, (u, v) in enumerate(ring))}) AS t(ring, k, u, v)"""
ZONE_EDGES = f"""
SELECT a.zid, a.vx AS ax, a.vy AS ay, b.vx AS bx, b.vy AS by_ FROM ({ZONES}) a JOIN ({ZONES}) b ON a.zid = b.zid AND a.ring = b.ring AND b.k = a.k + 1"""


def in_zone_sql(x: str, y: str, edge: str = "e") -> str:
    """Aggregate condition over the edges of a zone: an odd number of them lies to the right of the point."""
    return f"count(*) FILTER (({edge}.ay > {y}) <> ({edge}.by_ > {y}) AND {x} < {edge}.ax + ({y} - {edge}.ay) * ({edge}.bx - {edge}.ax) / ({edge}.by_ - {edge}.ay)) % 2 = 1"


# Hourly series: one per user.
SERIES = """
SELECT user_id AS ts_metadata_id, ts AS time, value - 30 AS value, event_type FROM events"""


def members(spark, sf) -> DataFrame:
    return spread_small(frame(spark, sf, MEMBERS))


def outlines(spark, sf) -> DataFrame:
    """Members with a rectangular outline and a centroid point."""
    return members(spark, sf).withColumns({
        "geom": G.make_box(F.col("x") - F.col("half_w"), F.col("y") - F.col("half_h"), F.col("x") + F.col("half_w"), F.col("y") + F.col("half_h")),
        "centroid": G.make_point("x", "y")})


def stations(spark, sf) -> DataFrame:
    return frame(spark, sf, STATIONS)


def point_boxed(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns({"xmin": F.col(x), "ymin": F.col(y), "xmax": F.col(x), "ymax": F.col(y)})


def cells(spark, sf) -> DataFrame:
    return frame(spark, sf, CELLS)


def ways(spark, sf, sql: str = WAYS) -> DataFrame:
    w = spread_small(frame(spark, sf, sql))
    return w.withColumn("geom", G.make_line(G.make_point("x1", "y1"), G.make_point("x2", "y2")))


def areas(spark, sf) -> DataFrame:
    return frame(spark, sf, AREAS).withColumn("area_geom", G.make_box("ax1", "ay1", "ax2", "ay2"))


def postcodes(spark, sf) -> DataFrame:
    return frame(spark, sf, POSTCODES).withColumn("plz_geom", G.make_box("px1", "py1", "px2", "py2"))


def zones(spark, sf) -> DataFrame:
    rings = frame(spark, sf, ZONES).groupBy("zid", "ring").agg(F.sort_array(F.collect_list(F.struct("k", "vx", "vy"))).alias("v")).select(
        "zid", "ring", F.transform("v", lambda p: G.make_point(p["vx"], p["vy"])).alias("line"))
    return rings.groupBy("zid").agg(F.sort_array(F.collect_list(F.struct("ring", "line"))).alias("r")).select("zid", F.transform("r", lambda r: r["line"]).alias("zone_geom"))


# Distance of the point (px, py) to the segment (x1, y1) - (x2, y2), as oracle text.
def segment_distance_sql(px: str, py: str, s: str = "") -> str:
    x1, y1, x2, y2 = (f"{s}{c}" for c in ("x1", "y1", "x2", "y2"))
    t = segment_foot_sql(px, py, s)
    return f"sqrt(power({x1} + ({t}) * ({x2} - {x1}) - {px}, 2) + power({y1} + ({t}) * ({y2} - {y1}) - {py}, 2))"


def segment_foot_sql(px: str, py: str, s: str = "") -> str:
    x1, y1, x2, y2 = (f"{s}{c}" for c in ("x1", "y1", "x2", "y2"))
    return (f"greatest(0e0, least(1e0, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / "
            f"(power({x2} - {x1}, 2) + power({y2} - {y1}, 2))))")
