"""Readers: files of the public data sets to DataFrames. Executors read, nothing passes the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import crs, geometry as G, scalar as S, text as T
from ..operators.clip import clip_lines, clip_multi, clip_points


def read_census_csv(spark: SparkSession, path: str | list[str], x_col: str, y_col: str, types: dict[str, str],
                    srid_src: int = 3035, srid_dst: int = 3035, clip: DataFrame | None = None,
                    clip_poly: str = "area_geom", encoding: str = "UTF-8") -> DataFrame:
    """Semicolon file with German numbers: lower-cased columns, typed values, a point ``geom``.

    With ``clip`` (polygons in the target system) only points inside remain.
    """
    raw = spark.read.csv(path, sep=";", header=True, inferSchema=False, encoding=encoding)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    x, y = x_col.lower(), y_col.lower()
    typed = S.cast_by_map(raw, types, (x, y))
    out = typed.withColumn("geom", crs.transform_point(G.make_point(x, y), srid_src, srid_dst))
    return out if clip is None else clip_points(out, "geom", clip, clip_poly)


_FEATURE = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
_GEOJSON = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def _ring(c: Column) -> Column:
    return F.transform(c, lambda p: G.make_point(F.get(p, 0), F.get(p, 1)))


def read_geojson(spark: SparkSession, path: str | list[str], layer: str = "germany", properties: list[str] | None = None,
                 kind: str = "multi", lines: bool = False) -> DataFrame:
    """Features of GeoJSON: requested properties, ``geom`` and the layer name.

    Collections are one document per file, so a file is read by one task and its features are spread
    afterwards. Large layers should come with one feature per line (``lines``), which Spark splits.
    """
    if lines:
        rows = spark.read.schema(_FEATURE).json(path).select(F.struct("type", "properties", "geometry").alias("f"))
    else:
        rows = spark.read.schema(_GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
        rows = rows.repartition(F.xxhash64("f.geometry.coordinates"))
    coords, gtype = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    if kind == "multi":
        geom = F.when(gtype == "Polygon", F.array(F.transform(F.from_json(coords, "array<array<array<double>>>"), _ring))).otherwise(
            F.transform(F.from_json(coords, "array<array<array<array<double>>>>"), lambda p: F.transform(p, _ring)))
    elif kind == "line":
        geom = _ring(F.from_json(coords, "array<array<double>>"))
    elif kind == "point":
        geom = G.let(F.from_json(coords, "array<double>"), lambda p: G.make_point(F.get(p, 0), F.get(p, 1)))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return rows.select(*[F.col("f.properties")[p].alias(p) for p in properties or []], F.lit(layer).alias("layer"), geom.alias("geom"))


def read_vector_layers(spark: SparkSession, paths: list[str], layers: list[str], names: dict[str, str] | None = None,
                       prefix: str = "", kind: str = "multi", properties: list[str] | None = None, srid_src: int = 4326,
                       srid_dst: int = 4326, clip: DataFrame | None = None, clip_poly: str = "area_geom") -> dict[str, DataFrame]:
    """Layers (files ``<path>/<layer>.geojson`` or ``.parquet`` folders) to prefixed tables.

    Files of one layer are stacked by column name; polygons become collections and are reprojected.
    With ``clip``, features whose box misses every clip area are left out and the others are cut.
    """
    out = {}
    for layer in layers:
        parts = []
        for p in paths:
            file = f"{p.rstrip('/')}/{layer}"
            if p.endswith(".parquet") or p.endswith("parquet/"):
                parts.append(spark.read.parquet(file))
            else:
                parts.append(read_geojson(spark, f"{file}.geojson", layer, properties, kind).drop("layer"))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        change = {"multi": crs.transform_multi, "line": crs.transform_line, "point": crs.transform_point}[kind]
        df = df.withColumn("geom", change("geom", srid_src, srid_dst))
        if clip is not None:
            df = {"multi": clip_multi, "line": clip_lines, "point": clip_points}[kind](df, "geom", clip, clip_poly)
        out[f"{prefix}{(names or {}).get(layer, layer)}"] = df
    return out


_ELEMENT = """map<string, struct<construction_data:string, inner_radiation:double, inner_convection:double,
 outer_radiation:double, outer_convection:double, building_age_group:array<int>,
 layer:map<string, struct<thickness:double, material:struct<material_id:string, name:string>>>>>"""
_MATERIAL = "map<string, struct<name:string, density:double, thermal_conduc:double, heat_capac:double>>"


def read_layered_json(spark: SparkSession, elements_path: str, materials_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested catalogue to elements, layers and materials; element ids derive from the entry name."""
    named = spark.read.text(elements_path, wholetext=True).select(
        F.explode(F.from_json("value", _ELEMENT)).alias("key", "e")).withColumn("element_id", F.xxhash64("key"))
    elements = named.select(
        "element_id", F.split("key", "_")[0].alias("element_name"), "e.construction_data", "e.inner_radiation",
        "e.inner_convection", "e.outer_radiation", "e.outer_convection",
        F.when(F.size("e.building_age_group") >= 2, F.get("e.building_age_group", 0)).alias("start_year"),
        F.when(F.size("e.building_age_group") >= 2, F.get("e.building_age_group", 1)).alias("end_year"))
    layers = named.select("element_id", F.explode("e.layer").alias("idx", "l")).select(
        "element_id", F.col("l.material.material_id").alias("material_id"), F.col("idx").cast("int").alias("layer_index"),
        F.col("l.material.name").alias("material_name"), F.col("l.thickness").alias("thickness"))
    materials = spark.read.text(materials_path, wholetext=True).select(
        F.explode(F.from_json("value", _MATERIAL)).alias("material_id", "m")).select("material_id", "m.*")
    return elements, layers, materials


def series_unit(variable) -> Column:
    v = G.col(variable)
    return (F.when(v.contains("temperature"), "°C").when(v.contains("wind_speed"), "m/s")
            .when(v.contains("precipitation"), "mm").otherwise(""))


def load_timeseries(raw: DataFrame, prefix: str = "openmeteo") -> tuple[DataFrame, DataFrame]:
    """Hourly arrays to metadata and narrow facts.

    ``raw``: grid_id, longitude, latitude, start (timestamp), step_seconds, variable,
    values (array<double>). Row i is the hour start + i * step; the end is exclusive by construction.
    """
    series_id = F.xxhash64("grid_id", "variable")
    meta = raw.select(
        series_id.alias("id"), F.concat(F.lit(f"{prefix}_hourly_"), "variable").alias("name"),
        # fixed value: the name of the column in existing tables
        F.concat(F.initcap(F.replace("variable", F.lit("_"), F.lit(" "))), F.lit(" from Open-Meteo, hourly")).alias("decription"),
        "grid_id", F.concat(F.lit("measurement:"), "variable").alias("type"), F.lit("1 hour").alias("resolution"),
        series_unit("variable").alias("unit"), F.lit(prefix).alias("group_id"),
        G.make_point("longitude", "latitude").alias("geom")).dropDuplicates(["id"])
    facts = raw.select(series_id.alias("ts_metadata_id"), "start", "step_seconds", F.posexplode("values").alias("pos", "value")).select(
        "ts_metadata_id", F.timestamp_seconds(F.unix_micros("start") / 1000000 + F.col("pos") * F.col("step_seconds")).alias("time"), "value")
    return meta, facts


def read_timeseries_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines {grid_id, longitude, latitude, start, step_seconds, hourly: {variable: [..]}} as ``raw``."""
    schema = "grid_id string, longitude double, latitude double, start timestamp, step_seconds long, hourly map<string,array<double>>"
    return spark.read.schema(schema).json(path).select(
        "grid_id", "longitude", "latitude", "start", "step_seconds", F.explode("hourly").alias("variable", "values"))


def read_city_xml(spark: SparkSession, path: str | list[str], row_tag: str = "bldg:Building") -> dict[str, DataFrame]:
    """Building elements of city XML as feature, property and geometry rows.

    The closing tag is the record separator, so Spark splits large files between tasks. Namespace
    prefixes, which are declared far away in the root element, are dropped before parsing.
    """
    schema = ("_id string, function string, storeysAboveGround long, measuredHeight double, "
              "attribute array<struct<_name:string, value:string>>, posList array<string>")
    tag = row_tag.split(":")[-1]
    text = spark.read.text(path, lineSep=f"</{row_tag}>").filter(F.col("value").contains(f"<{row_tag}"))
    body = F.regexp_extract("value", rf"(?s)<{row_tag}([\s>].*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(body, r"(</?)[\w.-]+:", "$1"), r"(\s)[\w.-]+:([\w.-]+\s*=)", "$1$2")
    rows = text.select(F.from_xml(F.concat(F.lit(f"<{tag}"), plain, F.lit(f"</{tag}>")), schema).alias("b")).select("b.*")
    rows = rows.withColumn("feature_id", F.xxhash64("_id"))
    feature = rows.select(F.col("feature_id").alias("id"), F.col("_id").alias("objectid"), F.lit(901).alias("objectclass_id"))
    typed = F.array(
        F.struct(F.lit("function").alias("name"), F.col("function").alias("val_string"), F.lit(None).cast("long").alias("val_int"), F.lit(None).cast("double").alias("val_double")),
        F.struct(F.lit("storeysAboveGround").alias("name"), F.lit(None).cast("string").alias("val_string"), F.col("storeysAboveGround").alias("val_int"), F.lit(None).cast("double").alias("val_double")),
        F.struct(F.lit("value").alias("name"), F.lit(None).cast("string").alias("val_string"), F.lit(None).cast("long").alias("val_int"), F.col("measuredHeight").alias("val_double")))
    generic = F.transform(F.coalesce("attribute", F.array().cast("array<struct<_name:string,value:string>>")), lambda a: F.struct(
        a["_name"].alias("name"), a["value"].alias("val_string"), F.lit(None).cast("long").alias("val_int"), F.lit(None).cast("double").alias("val_double")))
    prop = rows.select("feature_id", F.posexplode(F.concat(typed, generic)).alias("pos", "p")).select(
        F.xxhash64("feature_id", "pos").alias("id"), "feature_id", "p.*").filter(
        "val_string is not null or val_int is not null or val_double is not null")
    numbers = F.transform(F.split(F.trim("pos_list"), r"\s+"), lambda t: t.cast("double"))
    geometry = rows.select("feature_id", F.posexplode("posList").alias("pos", "pos_list")).withColumn("n", numbers).select(
        F.xxhash64("feature_id", "pos").alias("id"), "feature_id",
        F.transform(F.sequence(F.lit(0), (F.size("n") / 3).cast("int") - 1), lambda i: G.make_point(
            F.get("n", i * 3), F.get("n", i * 3 + 1), F.get("n", i * 3 + 2))).alias("points"))
    return {"feature": feature, "property": prop, "geometry_data": geometry}


def import_table(spark: SparkSession, path: str, kinds: dict[str, str], types: dict[str, str] | None = None,
                 srid: int = 25832) -> DataFrame:
    """CSV with WKT in the columns named geom..: parsed to geometry, other columns cast by ``types``."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    out = []
    for c in df.columns:
        if c.lower().startswith("geom"):
            out.append(T.from_wkt(c, kinds.get(c, "multi")).alias(c))
        else:
            out.append(F.col(c).cast((types or {}).get(c, "string")).alias(c))
    return df.select(*out, F.lit(srid).alias("srid"))


# ---------------------------------------------------------------- page links


def _absolute(base: Column, href: Column) -> Column:
    root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(root, href))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href)))


def page_hrefs(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)
    return pages.select("*", F.explode(F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))).alias("href")).drop(html)


def extract_links(pages: DataFrame, ending: str, contains: str = "", key: str = "page_id") -> DataFrame:
    """Absolute, distinct links per page with a suffix and a substring (lower case) in the href."""
    hits = page_hrefs(pages).filter(F.col("href").endswith(ending) & F.lower("href").contains(contains))
    return hits.select(key, _absolute(F.col("url"), F.col("href")).alias("link")).distinct()


def extract_endings(pages: DataFrame, ending: str = ".zip", key: str = "page_id") -> DataFrame:
    """Raw hrefs with a suffix, in page order, duplicates kept."""
    return page_hrefs(pages).filter(F.col("href").endswith(ending)).select(key, "href")


def manifest_diff(found: DataFrame, configured: DataFrame, col: str = "link") -> DataFrame:
    """Links on one side only: ``state`` is new (not configured) or gone (not found)."""
    f, c = found.select(col).distinct(), configured.select(col).distinct()
    return f.exceptAll(c).withColumn("state", F.lit("new")).unionByName(c.exceptAll(f).withColumn("state", F.lit("gone")))
