"""Street network (R1 - R11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans import network as R
from ..session import cut_lineage
from .base import (AREAS, LATTICE, MEMBERS, POSTCODES, WAYS, areas, frame, members, postcodes, query, segment_distance_sql,
                   segment_foot_sql, table, ways)
from .joins import box_span

_LEN = "sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))"
_SEG, _FOOT = segment_distance_sql("x", "y"), segment_foot_sql("x", "y")


@query("r1_clean_ways", f"""
SELECT w.id, a.ags, klasse, objektart, round({_LEN}, 6) AS length_geo FROM ({WAYS}) w JOIN ({AREAS}) a ON (x1 + x2) / 2e0 > ax1 AND (x1 + x2) / 2e0 < ax2 AND (y1 + y2) / 2e0 > ay1 AND (y1 + y2) / 2e0 < ay2
WHERE klasse IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND NOT (klasse = '2-HIGH' AND objektart <> 'F')""")
def _(spark, sf):
    # two parts per line: the whole segment and its middle half, both with the same centre
    w = ways(spark, sf)
    lines = w.select(F.col("o").alias("ogc_fid"), "klasse", "objektart", F.array(G.line_substring("geom", 0.25, 0.75), F.col("geom")).alias("parts"))
    out = R.clean_ways(lines, areas(spark, sf), ["1-URGENT", "2-HIGH", "3-MEDIUM"], {"2-HIGH": ["F"]})
    return out.select("id", "ags", "klasse", "objektart", F.round("length_geo", 6).alias("length_geo"))


_N0, _N1 = box_span("x1", "y1", "x2", "y2", "ax1", "ay1", "ax2", "ay2")


@query("r2_match_address_street", f"""
SELECT id, way_id FROM (SELECT m.id, w.o AS way_id, row_number() OVER (PARTITION BY m.id ORDER BY {_SEG}, w.o) AS rn
 FROM ({MEMBERS}) m JOIN ({WAYS}) w ON m.segment = CASE o % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'HOUSEHOLD' ELSE 'X' END AND x BETWEEN least(x1, x2) - 1000 AND greatest(x1, x2) + 1000
 JOIN ({AREAS}) a ON a.ags = m.ags AND least(x1, x2) <= ax2 AND greatest(x1, x2) >= ax1 AND least(y1, y2) <= ay2 AND greatest(y1, y2) >= ay1 AND {_N0} <= {_N1} WHERE {_SEG} <= 1000) q WHERE rn = 1""")
def _(spark, sf):
    w = ways(spark, sf).withColumn("name", F.when(F.col("o") % 4 == 0, "BUILDING").when(F.col("o") % 4 == 1, "HOUSEHOLD").otherwise("X"))
    named = R.named_ways(w.select(F.col("o").alias("way_id"), "geom", "name", F.lit(None).cast("string").alias("name_kurz")), areas(spark, sf))
    b = members(spark, sf).withColumn("street", F.concat("segment", F.lit(" 3;Other 5")))
    return R.match_address_street(b, named).filter("address_street_id is not null").select("id", F.col("address_street_id").alias("way_id"))


@query("r3_assign_way", f"""
SELECT m.id, n.way_id AS assigned_way_id FROM ({MEMBERS}) m LEFT JOIN (SELECT id, way_id FROM (SELECT m.id, w.id AS way_id, row_number() OVER (PARTITION BY m.id ORDER BY {_SEG}, w.id) AS rn
 FROM ({MEMBERS}) m JOIN ({WAYS}) w ON m.ags = w.ags AND x BETWEEN least(x1, x2) - 2000 AND greatest(x1, x2) + 2000 WHERE {_SEG} <= 2000 AND {_SEG} > 0.1) q WHERE rn = 1) n ON n.id = m.id""")
def _(spark, sf):
    return R.assign_way(members(spark, sf), ways(spark, sf), use_address=False).select("id", "assigned_way_id")


_ENDS = f"SELECT id, 'start' AS side, x1 AS px, y1 AS py FROM ({LATTICE}) l UNION ALL SELECT id, 'end', x2, y2 FROM ({LATTICE}) l"
_END_PAIRS = f"SELECT DISTINCT a.id, a.side, b.id AS n FROM ({_ENDS}) a JOIN ({_ENDS}) b ON a.px = b.px AND a.py = b.py AND a.id <> b.id"


@query("r4_merge_candidates", f"""
SELECT l.id AS way_id, CAST(coalesce(s.c, 0) AS INTEGER) AS start_cnt, coalesce(s.ids, []) AS start_neighbor_ids, CAST(coalesce(e.c, 0) AS INTEGER) AS end_cnt, coalesce(e.ids, []) AS end_neighbor_ids, CASE WHEN e.c > 0 THEN 0e0 END AS end_nearest_dist_m
FROM ({LATTICE}) l LEFT JOIN (SELECT id, count(*) AS c, list(n ORDER BY n) AS ids FROM ({_END_PAIRS}) p WHERE side = 'start' GROUP BY id) s ON s.id = l.id
LEFT JOIN (SELECT id, count(*) AS c, list(n ORDER BY n) AS ids FROM ({_END_PAIRS}) p WHERE side = 'end' GROUP BY id) e ON e.id = l.id""")
def _(spark, sf):
    return R.merge_candidates(ways(spark, sf, LATTICE)).select(
        "way_id", "start_cnt", "start_neighbor_ids", "end_cnt", "end_neighbor_ids", "end_nearest_dist_m")


@query("r5_chain_map", f"""
WITH RECURSIVE p AS MATERIALIZED ({_END_PAIRS}), e AS MATERIALIZED (SELECT id AS u, min(n) AS v FROM p GROUP BY id, side HAVING count(*) = 1), s AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT DISTINCT u AS id, u AS other FROM s UNION SELECT r.id, s.v FROM r JOIN s ON r.other = s.u)
SELECT id AS old_way_id, md5('chain:' || min(other)) AS new_way_id FROM r GROUP BY id""")
def _(spark, sf):
    return R.merge_chains(ways(spark, sf, LATTICE))[1]


# All ways of a chain join to one line: two points each, common ends once (ways without length add none). A place with an odd number of ends is an end of the line; rings have none.
@query("r5_merge_chains", f"""
WITH RECURSIVE p AS MATERIALIZED ({_END_PAIRS}), e AS MATERIALIZED (SELECT id AS u, min(n) AS v FROM p GROUP BY id, side HAVING count(*) = 1), s AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT DISTINCT u AS id, u AS other FROM s UNION SELECT r.id, s.v FROM r JOIN s ON r.other = s.u),
c AS (SELECT id, min(other) AS chain FROM r GROUP BY id),
m AS (SELECT coalesce(md5('chain:' || chain), l.id) AS new_id, l.* FROM ({LATTICE}) l LEFT JOIN c ON c.id = l.id),
g AS (SELECT new_id, arg_min(klasse, id) AS klasse, arg_min(objektart, id) AS objektart, round(sum({_LEN}), 6) AS len, CAST(greatest(count(*) FILTER (x1 <> x2 OR y1 <> y2) + 1, 2) AS INTEGER) AS n FROM m GROUP BY new_id),
o AS (SELECT new_id, x, y FROM (SELECT new_id, x1 AS x, y1 AS y FROM m UNION ALL SELECT new_id, x2, y2 FROM m) q GROUP BY new_id, x, y HAVING count(*) % 2 = 1),
f AS (SELECT new_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM o GROUP BY new_id)
SELECT g.new_id AS id, klasse, objektart, len, n, CAST(xmin AS DOUBLE) AS xmin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymin AS DOUBLE) AS ymin, CAST(ymax AS DOUBLE) AS ymax FROM g LEFT JOIN f ON f.new_id = g.new_id""")
def _(spark, sf):
    out = R.merge_chains(ways(spark, sf, LATTICE).withColumn("length_geo", G.length("geom")))[0].withColumns({"a": G.start_point("geom"), "b": G.end_point("geom")})
    open_ = F.col("a") != F.col("b")
    return out.select("id", "klasse", "objektart", F.round("length_geo", 6).alias("len"), F.size("geom").alias("n"), *[
        F.when(open_, f(f"a.{c}", f"b.{c}")).alias(f"{c}{name}") for c in "xy" for name, f in (("min", F.least), ("max", F.greatest))])


@query("r6_filter_ways_topology", f"""
WITH c AS (SELECT l.id, {_LEN} AS len, coalesce(k, 0) AS k, heir FROM ({LATTICE}) l LEFT JOIN (SELECT id, count(DISTINCT n) AS k, min(n) AS heir FROM ({_END_PAIRS}) p GROUP BY id) n ON n.id = l.id)
SELECT id AS old_way_id, CASE WHEN len = 0 THEN heir END AS new_way_id, round(len, 6) AS old_length_geo, CASE WHEN len = 0 THEN 'loop' WHEN k = 0 THEN 'isolated' ELSE 'short' END AS filter_type, CAST(k AS INTEGER) AS connection_count FROM c WHERE k = 0 OR len < 60""")
def _(spark, sf):
    w = ways(spark, sf, LATTICE).withColumn("length_geo", G.length("geom"))
    return R.filter_ways_topology(w, 60.0)[1].withColumn("old_length_geo", F.round("old_length_geo", 6))


# On the lattice only opposite diagonals of one square cross, in their middle.
_DIAG = f"SELECT id, least(x1, x2) AS qx, least(y1, y2) AS qy, (x2 - x1) * (y2 - y1) > 0 AS up FROM ({LATTICE}) l WHERE x1 <> x2 AND y1 <> y2"


@query("r7_split_at_crossings", f"""
SELECT DISTINCT a.id AS old_way_id, i AS part, round(sqrt(1250e0), 6) AS len FROM ({_DIAG}) a JOIN ({_DIAG}) b ON a.qx = b.qx AND a.qy = b.qy AND a.up <> b.up, (SELECT unnest([1, 2]) AS i)""")
def _(spark, sf):
    w = ways(spark, sf, LATTICE).withColumn("length_geo", G.length("geom"))
    pieces = R.split_at_crossings(w)[1]
    # parts are numbered by the id of the piece to compare them as a set
    from ..operators.tables import rank_within
    return rank_within(pieces.select("old_way_id", "new_way_id", F.round(G.length("new_geom"), 6).alias("len")), ["old_way_id"], [F.col("new_way_id")]).select(
        "old_way_id", F.col("rank").cast("int").alias("part"), "len")


_LINKS = f"SELECT m.id AS b, w.*, x, y, {_FOOT} AS f, {_LEN} AS len FROM ({MEMBERS}) m JOIN ({WAYS}) w ON o = m.id * 2 - m.id % 3"


def _linked(spark, sf):
    return members(spark, sf).withColumn("assigned_way_id", (F.col("id") * 2 - F.col("id") % 3).cast("string"))


@query("r8_connectors", f"""
SELECT * FROM (SELECT id AS connected_way_id, CAST(ags AS BIGINT) AS ags, md5('connector:' || CAST(b AS VARCHAR)) AS id, 'connection_line' AS klasse,
 round(CASE WHEN f * len < 0.15 THEN sqrt(power(x - x1, 2) + power(y - y1, 2)) WHEN (1 - f) * len < 0.15 THEN sqrt(power(x - x2, 2) + power(y - y2, 2)) ELSE {_SEG} END, 5) AS length_geo FROM ({_LINKS}) q) z WHERE length_geo > 0""")
def _(spark, sf):
    w = ways(spark, sf).withColumn("length_geo", G.length("geom"))
    return R.connect_buildings(_linked(spark, sf), w)[0].select("connected_way_id", "ags", "id", "klasse", F.round("length_geo", 5).alias("length_geo"))


@query("r8_connection_length", f"""
SELECT w.id, round(l, 5) AS length_connection_line FROM ({WAYS}) w LEFT JOIN (SELECT id, sum({_SEG}) AS l FROM ({_LINKS}) q WHERE f * len >= 0.15 AND (1 - f) * len >= 0.15 GROUP BY id) c ON c.id = w.id""")
def _(spark, sf):
    w = ways(spark, sf).withColumn("length_geo", G.length("geom"))
    return R.connect_buildings(_linked(spark, sf), w)[1].select("id", F.round("length_connection_line", 5).alias("length_connection_line"))


@query("r8_connected_network", f"""
WITH k AS (SELECT id, round(f, 9) AS f, len FROM ({_LINKS}) q WHERE f * len >= 0.15 AND (1 - f) * len >= 0.15), c AS (SELECT id, len, f, coalesce(lag(f) OVER (PARTITION BY id ORDER BY f), 0) AS f0 FROM (SELECT DISTINCT id, len, f FROM k) d)
SELECT 'segmented_way' AS klasse, round((f - f0) * len, 4) AS len FROM c UNION ALL SELECT 'segmented_way', round((1 - max(f)) * max(len), 4) FROM c GROUP BY id
UNION ALL SELECT klasse, round({_LEN}, 4) FROM ({WAYS}) w WHERE id NOT IN (SELECT id FROM c)""")
def _(spark, sf):
    w = ways(spark, sf).withColumn("length_geo", G.length("geom"))
    return R.connect_buildings(_linked(spark, sf), w)[2].select("klasse", F.round("length_geo", 4).alias("len"))


_P0, _P1 = box_span("x1", "y1", "x2", "y2", "px1", "py1", "px2", "py2")


@query("r9_assign_way_postcode", f"""
SELECT w.id, CAST(plz AS INTEGER) AS postcode FROM ({WAYS}) w LEFT JOIN (SELECT id, plz FROM (SELECT id, plz, row_number() OVER (PARTITION BY id ORDER BY ({_P1} - {_P0}) * {_LEN} DESC, plz) AS rn
 FROM ({WAYS}) w JOIN ({POSTCODES}) p ON least(x1, x2) <= px2 AND greatest(x1, x2) >= px1 AND least(y1, y2) <= py2 AND greatest(y1, y2) >= py1 WHERE {_P0} <= {_P1}) q WHERE rn = 1) b ON b.id = w.id""")
def _(spark, sf):
    return R.assign_way_postcode(ways(spark, sf), postcodes(spark, sf)).select("id", "postcode")


@query("r10_build_nodes", f"SELECT px, py, list(DISTINCT id ORDER BY id) AS way_ids, CAST(1 AS INTEGER) AS ags FROM ({_ENDS}) e GROUP BY px, py")
def _(spark, sf):
    # ends are moved by less than the tolerance and must still fall together
    w = frame(spark, sf, LATTICE)
    j = (F.col("o") % 5) * 0.02
    w = w.withColumn("geom", G.make_line(G.make_point(F.col("x1") + j, "y1"), G.make_point(F.col("x2") + j, "y2")))
    n = R.build_nodes(w)
    return n.select(F.round("geom.x", 0).alias("px"), F.round("geom.y", 0).alias("py"), "way_ids", "ags")


@query("r11_nearest_street", f"""
SELECT id AS building_id, street_id, round(d, 6) AS nearest_distance FROM (SELECT m.id, w.id AS street_id, {_SEG} AS d, row_number() OVER (PARTITION BY m.id ORDER BY {_SEG}, w.id) AS rn
 FROM ({MEMBERS}) m JOIN ({WAYS}) w ON x BETWEEN least(x1, x2) - 100 AND greatest(x1, x2) + 100 AND y BETWEEN least(y1, y2) - 100 AND greatest(y1, y2) + 100 WHERE {_SEG} <= 100) q WHERE rn = 1""")
def _(spark, sf):
    return R.nearest_street(members(spark, sf), ways(spark, sf)).select("building_id", "street_id", F.round("nearest_distance", 6).alias("nearest_distance"))


@query("r_build_network")
def _(spark, sf):
    lines = ways(spark, sf).select(F.col("o").alias("ogc_fid"), "klasse", "objektart", F.array("geom").alias("parts"))
    out = R.build_network(lines, areas(spark, sf), members(spark, sf).select("id", "ags", "x", "y"), postcodes(spark, sf), 10.0)
    kinds = None
    for name in ("ways_per_junction", "ways_per_connection", "connection_lines", "nodes_per_junction", "nodes_per_connection"):
        part = out[name].select(F.lit(name).alias("kind"), "ags", "id")
        kinds = part if kinds is None else kinds.unionByName(part)
    return kinds
