"""Domain rules: invariants and the decisions on semantic traps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.plans import buildings as B, features as FE, heat as H, network as R


def line_df(spark, rows):
    """rows: (id, [(x, y), ...])"""
    df = spark.createDataFrame([(i, [list(map(float, p)) for p in pts]) for i, pts in rows], "id string, p array<array<double>>")
    return df.select("id", F.lit("1").alias("ags"), F.lit("road").alias("klasse"), F.lit("t").alias("objektart"),
                     F.transform("p", lambda p: G.make_point(p[0], p[1])).alias("geom")).withColumn("length_geo", G.length("geom"))


def test_occupants_follow_the_cell_total(spark):
    b = spark.createDataFrame([(i, 1, 0, 0, "Residential", 3.0 + i % 4, 50.0 + i) for i in range(40)],
                              "id int, ags int, cx int, cy int, building_use string, height double, floor_area double")
    cells = spark.createDataFrame([(0, 0, 1000)], "cx int, cy int, einwohner int")
    total = B.allocate_occupants(b, cells, ["cx", "cy"]).agg(F.sum("occupants")).first()[0]
    assert abs(total - 1000) <= 20


def test_unknown_population_gives_one(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, "Residential", 3.0, 50.0), (2, 1, 9, 9, "Residential", 3.0, 50.0), (3, 1, 0, 0, "Public", 3.0, 50.0)],
                              "id int, ags int, cx int, cy int, building_use string, height double, floor_area double")
    cells = spark.createDataFrame([(0, 0, None)], "cx int, cy int, einwohner int")
    got = {r.id: r.occupants for r in B.allocate_occupants(b, cells, ["cx", "cy"]).collect()}
    assert got == {1: 1, 2: None, 3: None}


def test_null_heights_survive_the_filter(spark):
    df = spark.createDataFrame([(1, None), (2, 3.4), (3, 3.5)], "id int, height double")
    assert {r.id for r in B.drop_low(df).collect()} == {1, 3}


def test_code_filter_uses_one_character_wildcard(spark):
    df = spark.createDataFrame([("31001_1000", 1), ("310011000", 1), ("31001x2000", 1), ("31001_2463", 1), ("31001_1000", None)], "building_function_code string, geom int")
    assert {r[0] for r in B.select_buildings(df).collect()} == {"31001_1000", "31001x2000", "310011000"}


def test_largest_ground_surface_wins(spark):
    s = spark.createDataFrame([("a", 710, 5.0), ("a", 710, 9.0), ("a", 709, 50.0)], "building_objectid string, objectclass_id int, area double")
    assert B.ground_area(s).first().floor_area == 9


def test_fix_types_is_idempotent(spark):
    rows = [(i, "Residential", t, h, n) for i, (t, h, n) in enumerate((t, h, n) for t in (None, "AB", "MFH", "TH", "SFH") for h in (None, 1, 2, 4, 5) for n in (0, 2))]
    b = spark.createDataFrame(rows, "id int, building_use string, building_type string, households int, neighbour_count int")
    once = B.fix_types(b)
    assert once.select("id", "building_type").exceptAll(B.fix_types(once).select("id", "building_type")).isEmpty()


@pytest.mark.parametrize("stage", ["AB", "MFH", "TH"])
def test_rebalance_never_exceeds_the_adjustment(spark, stage):
    rng = np.random.default_rng(1)
    kinds = rng.choice(["AB", "MFH", "TH", "SFH"], 200)
    b = spark.createDataFrame([(i, f"o{i}", 1, int(i % 3), "Residential", str(kinds[i]), int(1 + i % 4), 2, float(50 + i), 5.0) for i in range(200)],
                              "id int, objectid string, ags int, cell int, building_use string, building_type string, households int, occupants int, floor_area double, height double")
    t = spark.createDataFrame([(c, 10 + c, 20, 5, 40, 75 + c) for c in range(3)], "cell int, target_ab long, target_mfh long, target_th long, target_sfh long, total_target long")
    out = B.rebalance(b, t, stage, ["cell"])
    assert out.count() == 200
    goal = {"AB": "target_ab", "MFH": "target_mfh", "TH": "target_th"}[stage]
    want = {r.cell: math.floor((2 * r[goal] * n + r.total_target) / (2 * r.total_target)) for r, n in zip(t.orderBy("cell").collect(), (67, 67, 66))}
    before = {r.cell: r.n for r in b.filter(F.col("building_type") == stage).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    after = {r.cell: r.n for r in out.filter(F.col("building_type") == stage).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    for c in range(3):
        low, high = sorted((before.get(c, 0), want[c]))
        assert low <= after.get(c, 0) <= high


def test_touching_pairs_stay_in_their_municipality(spark):
    b = spark.createDataFrame([(1, "a", 0.0), (2, "a", 10.0), (3, "b", 20.0)], "id int, ags string, x double").withColumns({
        "building_use": F.lit("Residential"), "floor_area": F.lit(100.0), "floor_number": F.lit(2),
        "geom": G.make_box("x", F.lit(0.0), F.col("x") + 10, F.lit(10.0))})
    assert {(r.a_id, r.b_id) for r in B.touching_neighbours(b).collect()} == {(1, 2), (2, 1)}


# ---------------------------------------------------------------- network


def test_crossing_gives_four_pieces(spark):
    w = line_df(spark, [("a", [(0, 0), (10, 0)]), ("b", [(5, -5), (5, 5)])])
    out, mapping = R.split_at_crossings(w)
    rows = out.select("geom", G.length("geom").alias("l")).collect()
    assert [round(r.l, 6) for r in rows] == [5, 5, 5, 5]
    assert mapping.groupBy("old_way_id").count().filter("count = 2").count() == 2


def test_touch_at_an_end_cuts_only_the_through_way(spark):
    w = line_df(spark, [("a", [(0, 0), (10, 0)]), ("b", [(4, 0), (4, 8)])])
    out, _ = R.split_at_crossings(w)
    assert sorted(round(r[0], 6) for r in out.select(G.length("geom")).collect()) == [4, 6, 8]


def test_chain_of_three_is_merged(spark):
    w = line_df(spark, [("a", [(0, 0), (1, 0)]), ("b", [(1.1, 0), (2, 0)]), ("c", [(3, 0), (2, 0)]), ("d", [(50, 0), (60, 0)])])
    out, mapping = R.merge_chains(w)
    got = {r.id: r.l for r in out.select("id", G.length("geom").alias("l")).collect()}
    assert len(got) == 2 and math.isclose(got["d"], 10)
    assert mapping.count() == 3 and mapping.select("new_way_id").distinct().count() == 1
    assert math.isclose(max(v for k, v in got.items() if k != "d"), 3.0, abs_tol=0.3)


def test_junction_of_three_is_not_merged(spark):
    w = line_df(spark, [("a", [(0, 0), (1, 0)]), ("b", [(1, 0), (2, 0)]), ("c", [(1, 0), (1, 5)])])
    assert R.chain_edges(w).count() == 0


def test_ends_near_places_against_brute_force(spark):
    """Ends that fall together exactly, within the tolerance and in a crowded place; two municipalities in the same place."""
    rng = np.random.default_rng(3)
    spots = rng.integers(0, 6, (160, 4)).astype(float)
    rows = [(f"w{k:03d}", int(k % 2), [(float(a + rng.choice([0, 0, 0.1, 0.15])), float(b)), (float(c), float(d + rng.choice([0, 0, 0.12])))]) for k, (a, b, c, d) in enumerate(spots) if (a, b) != (c, d)]
    rows += [(f"z{k:03d}", 1, [(50.0, 50.0), (60.0 + 5 * k, 60.0)]) for k in range(40)]
    rows += [("loop", 1, [(90.0, 0.0), (95.0, 0.0), (90.0, 0.1)]), ("tail", 1, [(90.0, 0.05), (90.0, 30.0)]), ("lone", 1, [(200.0, 0.0), (210.0, 0.0)]), ("next", 1, [(210.15, 0.0), (220.0, 0.0)])]
    df = spark.createDataFrame([(i, a, [{"x": x, "y": y} for x, y in line]) for i, a, line in rows], f"id string, ags int, geom {R.G.LINE}").repartition(3)
    gap = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    want, edges = {}, set()
    for i, a, line in rows:
        for side, p in (("start", line[0]), ("end", line[-1])):
            seen = {j: (gap(m[0], p) + gap(m[-1], p), min(gap(m[0], p), gap(m[-1], p))) for j, b, m in rows if j != i and a == b and min(gap(m[0], p), gap(m[-1], p)) <= 0.2}
            want[i, side] = (sorted(seen), min(seen, key=lambda j: (seen[j][0], j)) if seen else None)
            if len(seen) == 1:
                edges.add((min(i, *seen), max(i, *seen)))
    got = {(r.way_id, side): (r[f"{side}_neighbor_ids"], r[f"{side}_nearest_id"]) for r in R.merge_candidates(df).collect() for side in ("start", "end")}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {tuple(r) for r in R.chain_edges(df).collect()} == edges and len(edges) > 3


def test_loops_hand_over_their_length(spark):
    w = line_df(spark, [("loop", [(0, 0), (5, 5), (5, -5), (0, 0)]), ("main", [(-50, 0), (0, 0)]), ("lone", [(500, 500), (600, 600)])])
    kept, gone = R.filter_ways_topology(w, 1.0)
    table = {r.old_way_id: (r.filter_type, r.new_way_id) for r in gone.collect()}
    assert table == {"loop": ("loop", "main"), "lone": ("isolated", None)}
    assert math.isclose(kept.first().length_filter, 10 + 2 * math.sqrt(50))


def test_nodes_join_ends_within_the_tolerance(spark):
    w = line_df(spark, [("a", [(0, 0), (10, 0)]), ("b", [(10.15, 0), (20, 0)]), ("c", [(10.3, 0), (10, 20)]), ("d", [(10.6, 0), (30, 30)])])
    nodes = sorted(tuple(r.way_ids) for r in R.build_nodes(w).collect())
    assert ("a", "b", "c") in nodes and ("d",) in nodes and len(nodes) == 6


def test_connector_snaps_to_way_ends(spark):
    w = line_df(spark, [("a", [(0, 0), (10, 0)])])
    b = spark.createDataFrame([(1, -3.0, 4.0, "a"), (2, 5.0, 2.0, "a"), (3, 5.0, -7.0, "a"), (4, 9.9, 1.0, "a")], "id int, x double, y double, assigned_way_id string")
    connectors, ways, network = R.connect_buildings(b, w)
    lengths = sorted(round(r.length_geo, 4) for r in connectors.collect())
    assert lengths == sorted([5.0, 2.0, 7.0, round(math.hypot(0.1, 1), 4)])
    assert ways.first().length_connection_line == 9
    assert sorted(r.length_geo for r in network.collect()) == [5, 5]
    assert R.connect_buildings(b, w, count_all=True)[1].first().length_connection_line > 14


def parts_df(spark, rows):
    return spark.createDataFrame([(g, [{"x": float(x), "y": float(y)} for x, y in line]) for g, line in rows], f"g string, geom {R.G.LINE}").repartition(3)


def test_rings_branches_and_gaps(spark):
    rows = [("square", p) for p in ([(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1)], [(0, 1), (0, 0)])]
    rows += [("star", [(0, 0), p]) for p in ((1, 0), (0, 3), (-1, 0))]
    rows += [("gap", [(0, 0), (5, 0)]), ("gap", [(12, 0), (5.005, 0)]), ("gap", [(12.0, 0.004), (12.0, 0.008), (20, 0)]), ("gap", [(30, 0), (31, 0)])]
    rows += [("pair", [(0, 0), (1, 1), (2, 0)]), ("pair", [(0, 0), (1, -1), (2, 0)]), ("self", [(0, 0), (1, 0), (1, 1), (0, 0)]), ("short", [(1, 1)])]
    rows += [("two rings", p) for p in ([(0, 0), (2, 0)], [(2, 0), (2, 2), (0, 0)], [(9, 9), (9, 10)], [(9, 9), (8, 9), (9, 10)])]
    got = {r.g: [(p.x, p.y) for p in r.geom] for r in R.line_merge(parts_df(spark, rows), "g", tol=0.01).collect()}
    assert set(got) == {"square", "star", "gap", "pair", "self", "two rings"}
    assert got["square"] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)] and got["star"] == [(0, 0), (0, 3)]
    assert got["gap"] == [(0, 0), (5, 0), (12, 0), (12.0, 0.008), (20, 0)] or got["gap"] == [(0, 0), (5, 0), (5.005, 0), (12.0, 0.008), (20, 0)]
    assert got["pair"][0] == got["pair"][-1] == (0, 0) and len(got["pair"]) == 5 and len(got["self"]) == 4
    assert got["two rings"][0] == got["two rings"][-1] and set(got["two rings"]) == {(0, 0), (2, 0), (2, 2)}


def test_a_chain_of_many_ways(spark):
    """Ways in any order and direction; every round looks twice as far."""
    n = 100_000
    ways = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"), (F.xxhash64("id") % 2 == 0).alias("turn"))
    a, b = (G.make_point(F.col("x") + k, (F.col("x") + k) % 7) for k in (0, 1))
    mixed = ways.select("g", F.when(F.col("turn"), G.make_line(b, a)).otherwise(G.make_line(a, b)).alias("geom"))
    line = R.line_merge(mixed.repartition(4), "g", tol=0.01).select(F.transform("geom", lambda p: p["x"]).alias("xs")).first()["xs"]
    assert line in (list(map(float, range(n + 1))), list(map(float, range(n, -1, -1))))


# ---------------------------------------------------------------- heat


def swing_capacity(layers, first_film, last_film, cells=4000):
    """Heat that flows through the last film in a daily swing of both sides by one degree, over the
    angular speed: the heat equation on a fine grid, solved for one frequency."""
    omega = 2 * math.pi / 86400
    step = np.concatenate([np.full(cells, d / cells) for d, *_ in layers])
    k = np.concatenate([np.full(cells, k) for _, k, _, _ in layers])
    store = np.concatenate([np.full(cells, rho * c) for _, _, rho, c in layers]) * step
    half = step / (2 * k)
    link = 1 / np.concatenate([[first_film + half[0]], half[:-1] + half[1:], [half[-1] + last_film]])
    main = -(link[:-1] + link[1:]) - 1j * omega * store
    right = np.zeros(len(step), dtype=complex)
    right[0], right[-1] = -link[0], -link[-1]
    for i in range(1, len(step)):  # elimination down the band, then the last cell is known
        w = link[i] / main[i - 1]
        main[i] -= w * link[i]
        right[i] -= w * right[i - 1]
    return abs((1 - right[-1] / main[-1]) * link[-1]) / omega


def test_capacity_solves_the_heat_equation(spark):
    rows = spark.createDataFrame([
        ("SFH", "OuterWall", "x_SFH", 1900, 1950, 2, "render", 0.02, 0.9, 1000.0, 1800.0),
        ("SFH", "OuterWall", "x_SFH", 1900, 1950, 1, "brick", 0.24, 0.8, 900.0, 1600.0),
        ("SFH", "Window", "x_SFH", 1900, 1950, 1, "glass", 0.01, 0.8, 900.0, 2500.0)],
        "building_type string, element_name string, construction_data string, start_year int, end_year int, layer_index int, material_name string, thickness double, thermal_conduc double, heat_capac double, density double")
    got = {r.element_name: (r.R, r.C) for r in H.construction_table(rows).collect()}
    want = swing_capacity([(0.02, 0.9, 1800, 1000), (0.24, 0.8, 1600, 900)], 1 / 7.7, 1 / 25)
    assert math.isclose(got["OuterWall"][1], want, rel_tol=1e-5)
    assert math.isclose(got["OuterWall"][0], 0.02 / 0.9 + 0.3 + 1 / 7.7 + 1 / 25)
    assert got["Window"][1] == 0


def test_refurbishment_years_are_bounded_and_reproducible(spark):
    b = spark.createDataFrame([(f"o{i}", 1900 + i % 120, "1") for i in range(300)], "objectid string, construction_year int, ags string")
    plans = {"rooftop": H.Refurbishment(40, 10, 0.4)}
    a = H.simulate_refurbishment(b, 2020, plans, 7)
    again = H.simulate_refurbishment(b.repartition(5), 2020, plans, 7)
    assert a.exceptAll(again).isEmpty()
    assert a.filter("rooftop > 2020 or rooftop < construction_year").count() == 0
    done = H.harmonize_quota(a, plans, 7).filter("rooftop <> construction_year").count()
    assert done == min(round(0.4 * 300), a.filter("rooftop <> construction_year").count())


def test_preaggregated_demand_equals_the_direct_join(spark):
    rc = spark.createDataFrame([("a", 0.004), ("b", -0.002), ("c", 0.01)], "building_objectid string, resistance double")
    links = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("c", 3)], "bld_objectid string, ts_metadata_id int")
    meta = spark.createDataFrame([(1, H.TEMPERATURE), (2, H.TEMPERATURE), (3, "wind")], "id int, name string")
    data = spark.createDataFrame([(s, f"2024-01-{1 + i:02d}", float((i * 7 + s * 3) % 25)) for s in (1, 2, 3) for i in range(30)],
                                 "ts_metadata_id int, d string, value double").select("ts_metadata_id", F.to_timestamp("d").alias("time"), "value")
    args = (rc, links, meta, data, 20.0, "2024-01-01", "2024-01-29")
    fast = {r.building_objectid: r for r in H.annual_heat_demand(*args).collect()}
    slow = {r.building_objectid: r for r in H.annual_heat_demand_direct(*args).collect()}
    assert fast.keys() == slow.keys() == {"a", "b", "c"}
    for k in fast:
        assert math.isclose(fast[k].demand_kwh, slow[k].demand_kwh) and math.isclose(fast[k].pmax, slow[k].pmax)


def test_building_without_construction_raises(spark):
    b = spark.createDataFrame([("a", 100.0, 2, 50.0, 60.0, 10.0, "SFH", 1950, 1950, 1950, 1950)],
                              "objectid string, floor_area double, floor_number int, wall_area double, roof_area double, window_area double, building_type string, construction_year int, outer_wall int, rooftop int, window int")
    cons = spark.createDataFrame([("OuterWall", "SFH", "tabula_de_standard_1_SFH", 1900, 1960, 1.0, 2.0)],
                                 "element_name string, building_type string, construction_data string, start_year int, end_year int, R double, C double")
    with pytest.raises(Exception, match="no construction for building"):
        H.building_rc(b, cons).collect()


# ---------------------------------------------------------------- feature store


def store(spark):
    feature = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    prop = spark.createDataFrame([
        (10, 1, None, "boundary", 1, 2, 1, 100, None), (11, 1, None, "boundary", 1, 3, 1, None, None), (12, 4, None, "boundary", 1, 3, 1, None, None),
        (13, 2, None, "part", 1, 5, 1, None, 900), (14, 6, None, "related", 1, 1, 0, None, None), (15, 6, 14, "sub", 1, None, None, None, 901),
        (16, 7, None, "name", 1, None, None, None, None)],
        "id long, feature_id long, parent_id long, name string, namespace_id int, val_feature_id long, val_relation_type int, val_geometry_id long, val_address_id long")
    return {"feature": feature, "property": prop, "geometry_data": spark.createDataFrame([(100,), (101,)], "id long"),
            "address": spark.createDataFrame([(900,), (901,), (902,)], "id long")}


def test_cascade_delete(spark):
    out = FE.cascade_delete(store(spark), spark.createDataFrame([(1,)], "id long"))
    ids = {t: {r.id for r in out[t].select("id").collect()} for t in out}
    # 3 is also contained in 4 and stays; 5 goes with 2; the reference from 6 goes with its child row
    assert ids["feature"] == {3, 4, 6, 7} and ids["property"] == {12, 16}
    assert ids["address"] == {902} and ids["geometry_data"] == {101}


def test_terminate_waits_for_every_parent(spark):
    s = store(spark)
    feature = s["feature"].withColumns({"termination_date": F.lit(None).cast("timestamp"), "updating_person": F.lit(None).cast("string")})
    hit = lambda ids: {r.id for r in FE.terminate(feature, s["property"], spark.createDataFrame([(i,) for i in ids], "id long")).filter("termination_date is not null").collect()}
    assert hit([1]) == {1, 2, 5} and hit([1, 4]) == {1, 2, 3, 4, 5}


def test_envelope_with_implicit_geometry(spark):
    feature = spark.createDataFrame([(1,), (2,)], "id long")
    prop = spark.createDataFrame([(1, 2, 1, None, None, None), (2, None, None, 5, "[2,0,0,0, 0,2,0,0, 0,0,2,0, 0,0,0,1]", (10.0, 0.0, 0.0))],
                                 "feature_id long, val_feature_id long, val_relation_type int, val_implicitgeom_id long, val_array string, val_implicitgeom_refpoint struct<x:double,y:double,z:double>")
    geometry = spark.createDataFrame([(1, 1, [(0.0, 0.0, 0.0)], None), (2, None, None, [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)])],
                                     "id long, feature_id long, points array<struct<x:double,y:double,z:double>>, implicit_points array<struct<x:double,y:double,z:double>>")
    implicit = spark.createDataFrame([(5, 2)], "id long, relative_geometry_id long")
    r = FE.feature_envelope(feature, prop, geometry, spark.createDataFrame([(1,)], "id long"), implicit).first()
    assert (r.xmin, r.xmax, r.ymax, r.zmax) == (0, 12, 2, 2)


def test_child_changes_touch_their_parents(spark):
    schema = "id long, objectclass_id int, objectid string, last_modification_date timestamp, termination_date timestamp, reason_for_update string"
    from datetime import datetime as dt
    old = spark.createDataFrame([(1, 901, "b", dt(2024, 1, 1), None, None), (2, 709, "w", dt(2024, 1, 1), None, None)], schema)
    new = spark.createDataFrame([(1, 901, "b", dt(2024, 1, 1), None, None), (2, 709, "w", dt(2024, 2, 1), None, None)], schema)
    classes = spark.createDataFrame([(901, 1), (709, 0)], "id int, is_toplevel int")
    prop = spark.createDataFrame([(1, 2, 1)], "feature_id long, val_feature_id long, val_relation_type int")
    assert FE.feature_change_log(old, new, classes).count() == 0
    assert [(r.id, r.transaction_type) for r in FE.feature_change_log(old, new, classes, prop).collect()] == [(1, "UPDATE")]


def test_address_street_looks_close_by_first(spark, monkeypatch):
    """Streets of the name in every direction; most are settled within the first ring, one at the very end, one is too far."""
    reach, join = [], R.spatial.spatial_join

    def watched(left, right, predicate=None, eps=0.0, *rest, **more):
        reach.append(eps)
        return join(left, right, predicate, eps, *rest, **more)
    monkeypatch.setattr(R.spatial, "spatial_join", watched)
    rows = [(1, 1, 0.0, 0.0, "Hof 1;Weg 2"), (2, 1, 5000.0, 0.0, "Hof 3"), (3, 1, 9000.0, 0.0, "Hof 3"), (4, 2, 0.0, 0.0, "Hof 1"), (5, 1, 0.0, 0.0, None)]
    b = spark.createDataFrame(rows, "id long, ags long, x double, y double, street string")
    named = spark.createDataFrame([("a", 1, 100.0, "Hof", None), ("b", 1, 90.0, "Gasse", "Weg"), ("c", 1, 5900.0, "Hof", "Hof"), ("d", 1, 7900.0, "Hof", None), ("e", 1, 90.0, None, "Weg")],
                                  "way_id string, ags long, at double, name string, name_kurz string").withColumn(
        "geom", G.make_line(G.make_point("at", F.lit(-1)), G.make_point("at", F.lit(1)))).drop("at")
    got = {r["id"]: r["address_street_id"] for r in R.match_address_street(b, named).collect()}
    assert got == {1: "b", 2: "c", 3: None, 4: None, 5: None}
    assert len(reach) == 3 and reach == sorted(reach) and reach[0] <= 125 and reach[-1] == 1000
