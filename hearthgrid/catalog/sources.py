"""Sources and sinks: files are first written from the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, scalar as S, text as T
from ..operators import tables
from ..session import scratch_path
from ..sources import readers, writers
from .base import MEMBERS, frame, members, query, table

_CENSUS_SQL = f"""
SELECT id, CAST(x * 100 + 50 AS BIGINT) AS x, CAST(y * 100 + 50 AS BIGINT) AS y,
       CASE WHEN id % 7 = 0 THEN NULL ELSE id * 3 END AS einwohner,
       CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 17) / 4e0 END AS groesse FROM ({MEMBERS}) m"""


def _census_file(spark, sf):
    src = frame(spark, sf, _CENSUS_SQL)
    path = scratch_path(spark, "census")
    num = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",")
    src.select(
        F.col("id").cast("string").alias("GITTER_ID"), F.col("x").cast("string").alias("x_mp_100m"), F.col("y").cast("string").alias("y_mp_100m"),
        F.coalesce(F.col("einwohner").cast("string"), F.lit("–")).alias("Einwohner"),
        F.coalesce(num("groesse"), F.lit("-")).alias("Groesse")).write.csv(path, sep=";", header=True)
    return path


@query("s1_read_census_csv", f"""
SELECT CAST(id AS VARCHAR) AS gitter_id, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, CAST(einwohner AS BIGINT) AS einwohner, groesse
FROM ({_CENSUS_SQL}) WHERE x BETWEEN 0 AND 250000 AND y BETWEEN 100000 AND 300000""")
def _(spark, sf):
    clip = frame(spark, sf, "SELECT 0e0 AS a, 100000e0 AS b, 250000e0 AS c, 300000e0 AS d FROM region WHERE r_regionkey = 0").select(
        G.make_box("a", "b", "c", "d").alias("area_geom"))
    out = readers.read_census_csv(spark, _census_file(spark, sf), "x_mp_100m", "y_mp_100m",
                                  {"Einwohner": "integer", "groesse": "double precision"}, clip=clip)
    return out.select("gitter_id", F.col("geom.x").alias("px"), F.col("geom.y").alias("py"), "einwohner", "groesse")


def _geojson(spark, sf, src, props, geom_json, bucket):
    """Feature collections of about 500 features, one per file."""
    path = scratch_path(spark, "geojson")
    feature = F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', F.to_json(F.struct(*props)), geom_json)
    coll = src.select(bucket.alias("b"), feature.alias("f")).groupBy("b").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    coll.write.partitionBy("b").text(path)
    return path


def _box_json(x1, y1, x2, y2):
    return F.format_string('{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]}', *[
        F.col(c).cast("string") for c in (x1, y1, x2, y1, x2, y2, x1, y2, x1, y1)])


@query("s2_read_geojson", f"""
SELECT CAST(id AS VARCHAR) AS plz, 'germany' AS layer, (2 * half_w) * (2 * half_h) AS area, x - half_w AS xmin
FROM ({MEMBERS}) m""")
def _(spark, sf):
    m = members(spark, sf).withColumns({
        "x1": F.col("x") - F.col("half_w"), "x2": F.col("x") + F.col("half_w"), "y1": F.col("y") - F.col("half_h"), "y2": F.col("y") + F.col("half_h")})
    path = _geojson(spark, sf, m, [F.col("id").cast("string").alias("plz")], _box_json("x1", "y1", "x2", "y2"), F.floor(F.col("id") / 500))
    g = readers.read_geojson(spark, path, properties=["plz"])
    return g.select("plz", "layer", G.area_multi("geom").alias("area"), G.bbox_multi("geom")["xmin"].alias("xmin"))


@query("s3_read_vector_layers", f"""
SELECT CAST(id AS VARCHAR) AS name, 'bkg_' || CASE WHEN id % 2 = 0 THEN 'gemeinde' ELSE 'land' END AS table_name,
       round(greatest(least(x + half_w, 2000) - greatest(x - half_w, 500), 0) * greatest(least(y + half_h, 2000) - greatest(y - half_h, 500), 0), 4) AS area
FROM ({MEMBERS}) m WHERE x + half_w > 500 AND x - half_w < 2000 AND y + half_h > 500 AND y - half_h < 2000""")
def _(spark, sf):
    m = members(spark, sf).withColumns({
        "x1": F.col("x") - F.col("half_w"), "x2": F.col("x") + F.col("half_w"), "y1": F.col("y") - F.col("half_h"), "y2": F.col("y") + F.col("half_h")})
    root = scratch_path(spark, "layers")
    for part, layer in ((0, "gem"), (1, "lan")):
        src = m.filter(F.col("id") % 2 == part)
        feature = F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', F.to_json(F.struct(F.col("id").cast("string").alias("name"))), _box_json("x1", "y1", "x2", "y2"))
        src.select(F.floor(F.col("id") / 500).alias("b"), feature.alias("f")).groupBy("b").agg(
            F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value")
        ).write.partitionBy("b").text(f"{root}/{layer}.geojson")
    clip = table(spark, sf, "region").filter("r_regionkey = 0").select(
        G.make_box(F.lit(500.0), F.lit(500.0), F.lit(2000.0), F.lit(2000.0)).alias("area_geom"))
    layers = readers.read_vector_layers(spark, [root], ["gem", "lan"], {"gem": "gemeinde", "lan": "land"}, "bkg_", properties=["name"], clip=clip)
    out = None
    for name, df in layers.items():
        part = df.select("name", F.lit(name).alias("table_name"), F.round(G.area_multi("geom"), 4).alias("area"))
        out = part if out is None else out.unionByName(part)
    return out


_ELEMENTS = ("OuterWall", "Rooftop", "Window", "Door")


@query("s4_read_layered_json", """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'OuterWall' WHEN 1 THEN 'Rooftop' WHEN 2 THEN 'Window' ELSE 'Door' END AS element_name,
       p_brand AS construction_data, CAST(1900 + p_size AS INTEGER) AS start_year, CAST(1910 + p_size AS INTEGER) AS end_year,
       CAST(i AS INTEGER) AS layer_index, (p_size + i) / 8e0 AS thickness, 'mat' || CAST(p_size % 7 + i AS VARCHAR) AS material_name, CAST(p_size % 7 + i + 1 AS DOUBLE) AS density
FROM part, (SELECT unnest([0, 1]) AS i)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    kind = F.get(F.array(*[F.lit(e) for e in _ELEMENTS]), (F.col("p_partkey") % 4).cast("int"))
    layer = lambda i: F.struct(((F.col("p_size") + i) / F.lit(8.0)).alias("thickness"), F.struct(
        (F.col("p_size") % 7 + i).cast("string").alias("material_id"),
        F.concat(F.lit("mat"), (F.col("p_size") % 7 + i).cast("string")).alias("name")).alias("material"))
    doc = F.struct(
        F.concat_ws("_", kind, F.col("p_partkey").cast("string")).alias("key"),
        F.struct(F.col("p_brand").alias("construction_data"), F.lit(1.0).alias("inner_radiation"),
                 F.array(F.col("p_size") + 1900, F.col("p_size") + 1910).alias("building_age_group"),
                 F.create_map(F.lit("0"), layer(0), F.lit("1"), layer(1)).alias("layer")).alias("value"))
    epath, mpath = scratch_path(spark, "elements"), scratch_path(spark, "materials")
    p.groupBy(F.floor(F.col("p_partkey") / 500).alias("b")).agg(
        F.to_json(F.map_from_entries(F.collect_list(doc))).alias("value")).write.partitionBy("b").text(epath)
    # materials are the at most eight distinct ids of the layers
    ids = p.select(F.explode(F.array(F.col("p_size") % 7, F.col("p_size") % 7 + 1)).alias("m")).distinct()
    ids.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("m").cast("string").alias("key"), F.struct(F.concat(F.lit("mat"), F.col("m").cast("string")).alias("name"), (F.col("m") + 1).cast("double").alias("density")).alias("value"))))).alias("value")
    ).coalesce(1).write.text(mpath)
    e, l, mats = readers.read_layered_json(spark, epath, mpath)
    return e.join(l, "element_id").join(mats.select("material_id", "density"), "material_id").select(
        "element_name", "construction_data", "start_year", "end_year", "layer_index", "thickness", "material_name", "density")


_RAW = """
SELECT user_id, event_type, event_id, value,
  CASE event_type WHEN 'view' THEN 'temperature_2m' WHEN 'click' THEN 'wind_speed_10m' WHEN 'purchase' THEN 'precipitation' ELSE event_type END AS variable FROM events"""


@query("s5_load_timeseries", f"""
SELECT 'openmeteo_hourly_' || variable AS name, CAST(user_id AS VARCHAR) AS grid_id, 'measurement:' || variable AS type,
  CASE WHEN contains(variable, 'temperature') THEN '°C' WHEN contains(variable, 'wind_speed') THEN 'm/s' WHEN contains(variable, 'precipitation') THEN 'mm' ELSE '' END AS unit,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY user_id, variable ORDER BY event_id) - 1) AS time, value
FROM ({_RAW}) r""")
def _(spark, sf):
    r = frame(spark, sf, _RAW)
    raw = r.groupBy(F.col("user_id").cast("string").alias("grid_id"), "variable").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("values")).withColumns({
            "longitude": F.lit(11.5), "latitude": F.lit(48.1), "start": F.lit("2024-01-01 00:00:00").cast("timestamp"), "step_seconds": F.lit(3600)})
    meta, facts = readers.load_timeseries(raw)
    return facts.join(meta, F.col("ts_metadata_id") == F.col("id")).select("name", "grid_id", "type", "unit", "time", "value")


@query("s6_write_timeseries", """
SELECT user_id * 3 + k AS ts_metadata_id, ts AS time, CASE k WHEN 0 THEN value WHEN 1 THEN value * 2 ELSE value + 1 END AS value
FROM events, (SELECT unnest([0, 1, 2]) AS k)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    names = ["ro_heat_indoor_temperature", "ro_heat_heating_load", "ro_heat_cooling_load"]
    wide = e.select(F.col("user_id").cast("string").alias("objectid"), F.col("ts").alias("time"), F.col("value").alias("indoor"),
                    (F.col("value") * 2).alias("heating"), (F.col("value") + 1).alias("cooling"))
    meta = e.select("user_id").distinct().select("user_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("k", "name")).select(
        (F.col("user_id") * 3 + F.col("k")).alias("id"), "name", F.col("user_id").cast("string").alias("grid_id"))
    long = writers.timeseries_long(wide, meta, dict(zip(names, ("indoor", "heating", "cooling"))))
    path = scratch_path(spark, "series")
    writers.write_timeseries(long, path)
    return spark.read.parquet(path).select("ts_metadata_id", "time", "value")


@query("s7_read_city_xml", f"""
SELECT objectid, 'function' AS name, building_use_id AS val_string, NULL::BIGINT AS val_int, NULL::DOUBLE AS val_double FROM ({MEMBERS}) m
UNION ALL SELECT objectid, 'storeysAboveGround', NULL, storeysaboveground, NULL FROM ({MEMBERS}) m WHERE storeysaboveground IS NOT NULL
UNION ALL SELECT objectid, 'value', NULL, NULL, height FROM ({MEMBERS}) m
UNION ALL SELECT objectid, 'Gemeindeschluessel', CAST(ags AS VARCHAR), NULL, NULL FROM ({MEMBERS}) m""")
def _(spark, sf):
    m = members(spark, sf)
    path = scratch_path(spark, "cityxml")
    floors = F.when(F.col("storeysaboveground").isNull(), "").otherwise(
        F.format_string("<bldg:storeysAboveGround>%d</bldg:storeysAboveGround>", "storeysaboveground"))
    m.select(F.concat(
        F.format_string('<bldg:Building id="%s"><bldg:function>%s</bldg:function>', "objectid", "building_use_id"), floors,
        F.format_string('<bldg:measuredHeight>%s</bldg:measuredHeight><attribute name="Gemeindeschluessel"><value>%d</value></attribute>', F.col("height").cast("string"), "ags"),
        F.lit("<posList>0 0 0 4 0 0 4 0 3 0 0 3 0 0 0</posList></bldg:Building>")).alias("value")).write.text(path)
    out = readers.read_city_xml(spark, path, "bldg:Building")
    return out["property"].join(out["feature"].select(F.col("id").alias("feature_id"), "objectid"), "feature_id").select(
        "objectid", "name", "val_string", "val_int", "val_double")


@query("s8_write_partition", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders
WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch_path(spark, "parts")
    writers.write_partition(o, path, "o_orderstatus")
    again = o.filter("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    writers.write_partition(again, path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("s9_upsert", """
SELECT coalesce(u.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(u.o_totalprice + 1, t.o_totalprice) AS o_totalprice,
       CASE WHEN t.o_orderkey IS NULL THEN u.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus
FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) t FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) u ON t.o_orderkey = u.o_orderkey""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    updates = o.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return tables.upsert(o.filter("o_orderkey % 3 <> 0"), updates, ["o_orderkey"], ["o_totalprice"])


@query("s10_insert_ignore", """
SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey
UNION ALL SELECT o_custkey, min(o_orderdate) FROM orders WHERE o_custkey % 2 <> 0 GROUP BY o_custkey""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    target = o.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return tables.insert_ignore(target, o, ["o_custkey"])


@query("s11_begin_changelog", """
SELECT 'loader' AS tool, CAST(n_nationkey AS VARCHAR) AS ags, count(c_custkey) AS n, CAST(1 AS BIGINT) AS ids
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def _(spark, sf):
    # one run, stamped on all rows it loads
    entry = writers.begin_changelog(spark, "loader")
    rows = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("n_nationkey").cast("string").alias("ags"), "c_custkey")
    audit = entry.select(F.col("id").alias("changelog_id"), "tool")
    return writers.stamp(rows, entry).join(audit, "changelog_id").groupBy("tool", "ags").agg(
        F.count("c_custkey").alias("n"), F.count_distinct("changelog_id").alias("ids"))


_POINT_SQL = f"SELECT id, x + 0.5 AS x, y, segment FROM ({MEMBERS}) m"


@query("s12_export_table", f"""
SELECT CAST(id AS VARCHAR) AS id, segment, 'POINT(' || CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) || '.5 ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ')' AS geom
FROM ({_POINT_SQL}) p""")
def _(spark, sf):
    m = frame(spark, sf, _POINT_SQL).select("id", "segment", G.make_point("x", "y").alias("geom"))
    path = scratch_path(spark, "export")
    writers.export_table(m, path)
    return spark.read.csv(path, header=True)


@query("s13_import_table", f"SELECT id, segment, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, 25832 AS srid FROM ({_POINT_SQL}) p")
def _(spark, sf):
    m = frame(spark, sf, _POINT_SQL).select("id", "segment", G.make_point("x", "y").alias("geom"))
    path = scratch_path(spark, "export")
    writers.export_table(m, path)
    back = readers.import_table(spark, path, {"geom": "point"}, {"id": "bigint"})
    return back.select("id", "segment", F.col("geom.x").alias("px"), F.col("geom.y").alias("py"), "srid")


@query("s15_run_sql_steps", """
SELECT o_custkey, count(*) AS n, max(o_totalprice) * 2 AS top FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey""")
def _(spark, sf):
    return writers.run_steps(table(spark, sf, "orders"), [
        ("02_group.sql", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM {input} GROUP BY o_custkey"),
        ("01_filter.sql", "SELECT * FROM {input} WHERE o_totalprice > :low"), ("00_empty.sql", "  "),
        ("03_double", lambda df: df.withColumn("top", F.col("top") * 2))], low=1000)


_HREFS = r"""SELECT page_id, url, replace(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)), '&amp;', '&') AS href FROM pages"""
_ABSOLUTE = r"""CASE WHEN regexp_matches(href, '^[a-zA-Z][\w+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][\w+.-]*:)', 1) || href
 WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1) || href
 ELSE regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1) || CASE WHEN regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '') END || href END"""


@query("s17_extract_links", f"""
SELECT DISTINCT page_id, {_ABSOLUTE} AS link FROM ({_HREFS}) h WHERE ends_with(href, 'e') AND contains(lower(href), 'th')""")
def _(spark, sf):
    return readers.extract_links(table(spark, sf, "pages"), "e", "th")


@query("s17_extract_endings", f"SELECT page_id, href FROM ({_HREFS}) h WHERE ends_with(href, 'en')")
def _(spark, sf):
    return readers.extract_endings(table(spark, sf, "pages"), "en")


@query("s18_manifest_diff", f"""
WITH f AS (SELECT DISTINCT {_ABSOLUTE} AS link FROM ({_HREFS}) h), c AS (SELECT DISTINCT url AS link FROM pages)
SELECT link, 'new' AS state FROM f WHERE link NOT IN (SELECT link FROM c) UNION ALL SELECT link, 'gone' FROM c WHERE link NOT IN (SELECT link FROM f)""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    return readers.manifest_diff(readers.extract_links(pages, ""), pages.select(F.col("url").alias("link")))


@query("s19_split_url", r"""
SELECT page_id, f AS filename, CASE WHEN regexp_matches(f, '^\.*[^.].*\.') THEN regexp_replace(f, '\.[^.]*$', '') ELSE f END AS stem,
       CASE WHEN regexp_matches(f, '^\.*[^.].*\.') THEN regexp_extract(f, '(\.[^.]*)$', 1) ELSE '' END AS extension
FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS f FROM pages) q""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.split_url("url").alias("u")).select("page_id", "u.*")
