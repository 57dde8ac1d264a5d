import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.sources import readers, writers
from hearthgrid.streaming.incremental import stream_timeseries


def test_census_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("GITTER;X_mp_100m;y_mp_100m;Anzahl;Mittel\na;4000050;3000050;12;2,5\nb;4000150;3000050;–;—\nc;9000050;3000050;7;1,0\n", encoding="utf-8")
    area = spark.range(1).select(G.make_box(F.lit(3999000.0), F.lit(2999000.0), F.lit(4001000.0), F.lit(3001000.0)).alias("area_geom"))
    got = readers.read_census_csv(spark, str(tmp_path), "x_mp_100m", "y_mp_100m", {"anzahl": "int", "Mittel": "double"}, clip=area).orderBy("gitter").collect()
    assert [(r.gitter, r.anzahl, r.mittel) for r in got] == [("a", 12, 2.5), ("b", None, None)]
    assert got[0].geom.x == 4000050


def test_geojson_polygon_and_multipolygon(spark, tmp_path):
    sq = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"plz": "1", "note": 3}, "geometry": {"type": "Polygon", "coordinates": sq}},
        {"type": "Feature", "properties": {"plz": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [sq, sq]}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(doc, indent=1))
    got = {r.plz: len(r.geom) for r in readers.read_geojson(spark, str(tmp_path), properties=["plz"]).collect()}
    assert got == {"1": 1, "2": 2}
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "p.ndjson").write_text("\n".join(json.dumps(f) for f in doc["features"]))
    one_per_line = readers.read_geojson(spark, str(tmp_path / "lines"), properties=["plz"], lines=True)
    assert {r.plz: len(r.geom) for r in one_per_line.collect()} == got


def test_city_xml_with_namespaces(spark, tmp_path):
    xml = """<?xml version="1.0"?><core:CityModel xmlns:bldg="u" xmlns:gml="g" xmlns:core="c">
<core:cityObjectMember><bldg:Building gml:id="B1"><bldg:function>31001_1000</bldg:function><bldg:storeysAboveGround>3</bldg:storeysAboveGround>
<bldg:measuredHeight>9.5</bldg:measuredHeight></bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building gml:id="B2"><bldg:function>31001_2000</bldg:function></bldg:Building></core:cityObjectMember></core:CityModel>"""
    (tmp_path / "a.gml").write_text(xml)
    out = readers.read_city_xml(spark, str(tmp_path))
    assert {r.objectid for r in out["feature"].collect()} == {"B1", "B2"}
    rows = {(r.name, r.val_string, r.val_int, r.val_double) for r in out["property"].collect()}
    assert ("storeysAboveGround", None, 3, None) in rows and ("value", None, None, 9.5) in rows and len(rows) == 4


def test_catalogue_json(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"OuterWall_1_SFH": {
        "construction_data": "tabula_de_standard_1_SFH", "building_age_group": [1900, 1918],
        "layer": {"0": {"thickness": 0.1, "material": {"material_id": "m1", "name": "brick"}}, "1": {"thickness": 0.2, "material": {"material_id": "m1", "name": "brick"}}}}}))
    (tmp_path / "m.json").write_text(json.dumps({"m1": {"name": "brick", "density": 1600.0, "thermal_conduc": 0.8, "heat_capac": 900.0}}))
    e, l, m = readers.read_layered_json(spark, str(tmp_path / "e.json"), str(tmp_path / "m.json"))
    assert e.first().element_name == "OuterWall" and e.first().start_year == 1900
    assert sorted(r.layer_index for r in l.collect()) == [0, 1] and m.first().density == 1600


def test_partition_replacement_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_partition(spark.createDataFrame([(1, "a"), (2, "b")], "v int, ags string"), path, "ags")
    writers.write_partition(spark.createDataFrame([(9, "a")], "v int, ags string"), path, "ags")
    assert sorted((r.v, r.ags) for r in spark.read.parquet(path).collect()) == [(2, "b"), (9, "a")]


def test_changelog_stamp(spark):
    entry = writers.begin_changelog(spark, "tool", ags="09")
    got = writers.stamp(spark.range(3), entry)
    ids = {r.changelog_id for r in got.collect()}
    assert ids == {entry.first().id} and entry.first().tool == "tool"


def test_sql_folder(spark, tmp_path):
    (tmp_path / "02_b.sql").write_text("SELECT v * 2 AS v FROM {input}")
    (tmp_path / "01_a.sql").write_text("SELECT v + :n AS v FROM {input}")
    (tmp_path / "00.sql").write_text("\n")
    got = writers.run_sql_folder(spark, str(tmp_path), spark.createDataFrame([(1,), (2,)], "v int"), n=10)
    assert sorted(r.v for r in got.collect()) == [22, 24]


def test_export_and_import(spark, tmp_path):
    df = spark.range(3).select("id", G.to_multi(G.make_box(F.col("id") + 0.25, F.lit(0.0), F.col("id") + 2, F.lit(1.0))).alias("geom"), F.lit('a "b", c').alias("note"))
    writers.export_table(df, str(tmp_path / "x"))
    back = readers.import_table(spark, str(tmp_path / "x"), {"geom": "multi"}, {"id": "bigint"}).drop("srid")
    assert back.select("id", "geom", "note").exceptAll(df.select("id", "geom", "note")).isEmpty()


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://h.de/a/b.html?x=1", '<a class="k" href="f/Census_100m.zip">x</a><A HREF="x"></A><a href="/r.zip"><a href=\'//o.de/s.zip\'><a href="f/Census_100m.zip">')],
                                  "page_id int, url string, html string")
    assert {r.link for r in readers.extract_links(pages, ".zip").collect()} == {
        "https://h.de/a/f/Census_100m.zip", "https://h.de/r.zip", "https://o.de/s.zip"}
    assert [r.link for r in readers.extract_links(pages, ".zip", "census").collect()] == ["https://h.de/a/f/Census_100m.zip"]
    assert readers.extract_endings(pages).count() == 4


def test_series_stream_is_repeatable(spark, tmp_path):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()

    def put(name, start, values):
        (src / name).write_text(json.dumps({"grid_id": "g1", "longitude": 11.0, "latitude": 48.0, "start": start, "step_seconds": 3600, "hourly": {"temperature_2m": values}}) + "\n")

    put("a.json", "2024-01-01T22:00:00", [1.0, 2.0, 3.0])
    stream_timeseries(spark, str(src), out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    # the second file overlaps the first by one hour and replaces its value
    put("b.json", "2024-01-02T00:00:00", [30.0, 4.0])
    stream_timeseries(spark, str(src), out, chk).awaitTermination()
    got = {r.time: r.value for r in spark.read.parquet(out).collect()}
    assert got == {datetime(2024, 1, 1, 22): 1.0, datetime(2024, 1, 1, 23): 2.0, datetime(2024, 1, 2, 0): 30.0, datetime(2024, 1, 2, 1): 4.0}


def test_long_series_drop_null_times(spark):
    wide = spark.createDataFrame([("o", None, 1.0, 2.0), ("o", datetime(2024, 1, 1), 3.0, 4.0)], "objectid string, time timestamp, a double, b double")
    meta = spark.createDataFrame([(1, "x", "o"), (2, "y", "o")], "id int, name string, grid_id string")
    got = {(r.ts_metadata_id, r.value) for r in writers.timeseries_long(wide, meta, {"x": "a", "y": "b"}).collect()}
    assert got == {(1, 3.0), (2, 4.0)}


def test_missing_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from hearthgrid import session

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
