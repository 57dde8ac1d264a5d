"""Building enrichment. All municipalities run at once: ``ags`` is a grouping column.

Buildings: id, objectid, ags, building_use, building_use_id, height, floor_area, ... and, where
geometry is needed, ``geom`` (polygon) and ``centroid`` (point). Cells: cell_id, x_mp, y_mp and
census values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import crs, geometry as G, scalar as S
from ..operators import graph, spatial, tables
from ..session import cut_lineage

# Fixed codes and thresholds.
GARAGE, WATER_TANK = "31001_2463", "31001_2513"
GROUND_SURFACE = 710
MIN_HEIGHT, MIN_AREA = 3.5, 12
TOUCH_EPS = 0.01
DEFAULT_FLOOR_HEIGHT = {"Residential": 3.0, "Commercial": 3.5, "Public": 3.5}
PERIOD_COLUMNS = (
    "vor1919", "a1919bis1948", "a1949bis1978", "a1979bis1990",
    "a1991bis2000", "a2001bis2010", "a2011bis2019", "a2020undspaeter",
)
TYPE_COLUMNS = (
    "freiefh", "efh_dhh", "efh_reihenhaus", "freist_zfh", "zfh_dhh", "zfh_reihenhaus",
    "mfh_3bis6wohnungen", "mfh_7bis12wohnungen", "mfh_13undmehrwohnungen",
)


def select_buildings(view: DataFrame) -> DataFrame:
    code = F.col("building_function_code")
    return view.filter(code.like("31001_%") & ~code.isin(GARAGE, WATER_TANK) & F.col("geom").isNotNull())


def drop_low(df: DataFrame, height: str = "height") -> DataFrame:
    return df.filter(tables.outside_range(F.col(height), MIN_HEIGHT))


def drop_small(df: DataFrame, area: str = "floor_area") -> DataFrame:
    return df.filter(tables.outside_range(F.col(area), MIN_AREA))


def fill_surface_area(surfaces: DataFrame) -> DataFrame:
    """Given area, else the area of the surface in space; ``is_synthetic`` tells which."""
    return surfaces.withColumn("is_synthetic", F.col("area").isNull()).withColumn(
        "area", F.when(F.col("area").isNull(), G.area3d("geom")).otherwise(F.col("area")))


def ground_area(surfaces: DataFrame) -> DataFrame:
    """One ground surface per building: the largest."""
    return surfaces.filter(F.col("objectclass_id") == GROUND_SURFACE).groupBy(
        F.col("building_objectid").alias("objectid")).agg(F.max("area").alias("floor_area"))


def make_grid(areas: DataFrame, poly: str, resolutions: list[str], target_srid: int = 3035) -> DataFrame:
    """Grid cells covered by any area: id, mid point, name, geometry; units other than m/km are skipped."""
    out = None
    for res in resolutions:
        unit = 1000 if res.endswith("km") else 1
        digits = res[:-2] if res.endswith("km") else res[:-1]
        if not res.endswith("m") or not digits.isdigit():
            continue
        size = int(digits) * unit
        cells = spatial.covered_grid(areas.select(poly), poly, size).select("gx", "gy").distinct().select(
            S.grid_id(res, "gy", "gx").alias("id"),
            (F.col("gx") + size / 2).cast("int").alias("x_mp"), (F.col("gy") + size / 2).cast("int").alias("y_mp"),
            F.lit(f"DE_Grid_ETRS89_LAEA_{res}").alias("name"), F.lit(size).alias("resolution_meters"),
            crs.transform_polygon(G.make_box("gx", "gy", F.col("gx") + size, F.col("gy") + size), 3035, target_srid).alias("geom"))
        out = cells if out is None else out.unionByName(cells)
    if out is None:
        raise ValueError("no usable resolution")
    return out


def assign_cells(b: DataFrame, size: int, source_srid: int = 3035, grid_srid: int = 3035,
                 point: str = "centroid") -> DataFrame:
    """Mid point of the grid cell that holds each building: an equi-join key for census tables."""
    p = "__grid_point"
    out = b.withColumn(p, crs.transform_point(point, source_srid, grid_srid))
    return out.withColumns({
        "x_mp": (F.floor(F.col(f"{p}.x") / size) * size + size / 2).cast("int"),
        "y_mp": (F.floor(F.col(f"{p}.y") / size) * size + size / 2).cast("int")}).drop(p)


def enrich_grid(cells: DataFrame, census: dict[str, DataFrame], resolution: str = "100m") -> DataFrame:
    """Left joins of census tables (columns x_mp_<res>, y_mp_<res>, values) to the cells."""
    out = cells
    for table in census.values():
        src = table.withColumnsRenamed({f"x_mp_{resolution}": "x_mp", f"y_mp_{resolution}": "y_mp"})
        out = out.join(src, ["x_mp", "y_mp"], "left")
    return out


def occupied_cells(cells: DataFrame, areas: DataFrame, buildings: DataFrame, poly: str) -> DataFrame:
    """Cells (columns cell_id, box) that meet an area and hold at least one of its buildings."""
    hit = spatial.spatial_join(
        spatial.with_polygon_box(cells, "cell_geom"), spatial.with_polygon_box(areas, poly),
        lambda l, r: G.intersects_polygons(l("cell_geom"), r(poly))).drop(*spatial.BOX)
    return hit.join(buildings.select("ags", "cell_id").distinct(), ["ags", "cell_id"], "left_semi")


def impute_floors(b: DataFrame, min_samples: int = 5) -> DataFrame:
    """Storeys from the source when plausible, else height over the usual height of a floor."""
    h, n = F.col("height"), F.col("storeysaboveground")
    plausible = (n.isNotNull() & (n != 0) & ~F.coalesce(h < 2.0 * n, F.lit(False))
                 & ~F.coalesce(h > 6.0 * n, F.lit(False)))
    known = b.withColumn("floor_number", F.when(plausible, n.cast("int")))
    usual = tables.median_with_support(
        known.filter(F.col("floor_number") > 0), ["ags", "building_use_id"],
        h / F.col("floor_number"), min_samples).filter("median is not null").select(
        "ags", "building_use_id", F.col("median").alias("__usual"))
    default = F.lit(3.0)
    for use, value in DEFAULT_FLOOR_HEIGHT.items():
        default = F.when(F.col("building_use") == use, F.lit(value)).otherwise(default)

    def floors(per_floor):
        return F.greatest(F.rint(h / per_floor), F.lit(1.0)).cast("int")

    return known.join(usual, ["ags", "building_use_id"], "left").withColumn(
        "floor_number", F.coalesce(
            F.col("floor_number"), F.when(F.col("__usual").isNotNull(), floors(F.col("__usual"))),
            floors(default))).drop("__usual")


def allocate_occupants(b: DataFrame, cells: DataFrame, cell: list[str], weight: Column | None = None,
                       population: str = "einwohner", fallback: bool = False) -> DataFrame:
    """Population of a cell shared among its residential buildings by volume, at least one each.

    ``fallback`` gives buildings in cells without population the count of the nearest cell that
    has one, by their share of the weight there; the default keeps the strict result.
    """
    weight = F.col("height") * F.col("floor_area") if weight is None else weight
    group = ["ags", *cell]
    home = F.col("building_use") == "Residential"
    # the sums are aggregated before they meet the rows; the buildings themselves move once per key
    totals = b.filter(home).withColumn("__w", weight).groupBy(*group).agg(F.sum("__w").alias("__total"))
    placed = b.join(cells.select(*cell, F.col(population).alias("__pop"), F.lit(True).alias("__in")), cell, "left").join(
        totals, group, "left")

    def people(share, count):
        return F.greatest(F.rint(share * count), F.lit(1.0)).cast("int")

    total = F.when(F.col("__total") > 0, F.col("__total"))
    own = F.when(total.isNotNull(), people(weight / total, F.col("__pop"))).otherwise(F.lit(0))
    out = placed.withColumn("occupants", F.when(F.col("__in") & home, own))
    if fallback:
        lost = out.filter(F.col("__in") & home & F.col("__pop").isNull()).select("id", "x", "y", "ags", weight.alias("__w"))
        known = cells.filter(F.col(population).isNotNull()).select(
            "ags", F.struct(*cell).alias("__near"), F.col(population).alias("__near_pop"), *spatial.BOX)
        near = spatial.knn_join(lost, known, "id", "__near", spatial.point_to_box, by=["ags"]).select(
            F.col("id").alias("__id"), "ags", "__near.*", "__near_pop")
        share = near.join(totals.filter("__total > 0"), group).join(lost.select(F.col("id").alias("__id"), "__w"), "__id").select(
            F.col("__id").alias("id"), people(F.col("__w") / F.col("__total"), F.col("__near_pop")).alias("__o"))
        out = out.join(share, "id", "left").withColumn("occupants", F.coalesce("__o", "occupants")).drop("__o")
    return out.drop("__pop", "__in", "__total")


def derive_households(b: DataFrame, cells: DataFrame, cell: list[str], size: str = "durchschnhhgroesse") -> DataFrame:
    """Occupants over the mean household size of the cell, at least one."""
    homes = F.greatest(F.rint(F.col("occupants") / F.col(size)), F.lit(1.0)).cast("int")
    placed = cells.select(*cell, size, F.lit(True).alias("__in"))
    return b.join(placed, cell, "left").withColumn("households", F.when(
        F.col("__in") & F.col("occupants").isNotNull() & (F.col("building_use") == "Residential"), homes)).drop(size, "__in")


def assign_construction_period(b: DataFrame, cells: DataFrame, cell: list[str], seed, key: str = "objectid",
                               weights: tuple[str, ...] = PERIOD_COLUMNS,
                               labels: tuple[str, ...] = S.PERIODS, by: list[str] | None = None) -> DataFrame:
    """Weighted draw from the periods of the own cell, else of the nearest cell that has any."""
    clean = cells.select(*cell, *(by or []), *[S.nan_to_zero(w).alias(w) for w in weights],
                         *[c for c in spatial.BOX if c in cells.columns])
    drawn = b.withColumn("__r", S.hash_uniform(seed, key))
    own = drawn.join(clean.drop(*spatial.BOX), [*cell, *(by or [])], "left").withColumn(
        "construction_year", S.weighted_choice(list(weights), list(labels), "__r")).drop(*weights)
    if "xmin" not in cells.columns:
        return own.drop("__r")
    total = sum((F.col(w) for w in weights[1:]), F.col(weights[0]))
    right = clean.filter(total > 0).withColumn("__near", F.struct(*cell)).drop(*cell)
    todo = own.filter("construction_year is null").select("id", "x", "y", "__r", *(by or []))
    near = spatial.knn_join(todo, right, "id", "__near", spatial.point_to_box, by=by).join(
        todo.select("id", "__r"), "id").select(
        "id", S.weighted_choice(list(weights), list(labels), "__r").alias("__y"))
    return own.join(near, "id", "left").withColumn(
        "construction_year", F.coalesce("construction_year", "__y")).drop("__y", "__r")


def assign_postcode(b: DataFrame, postcodes: DataFrame, point: str = "centroid", poly: str = "plz_geom") -> DataFrame:
    """Postcode whose area holds the centroid (the smallest, should areas overlap)."""
    hit = spatial.points_in_polygons(b.select("id", point), postcodes.select("plz", poly), point, poly)
    return b.join(hit.groupBy("id").agg(F.min(F.col("plz").cast("int")).alias("postcode")), "id", "left")


def nearest_series(b: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """Per building and variable the nearest series, its distance and the connector.

    ``b``: objectid, geom, centroid; ``series``: ts_metadata_id, ts_metadata_name, ts_geom (point).
    """
    left = b.withColumn("ts_metadata_name", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn(
        "lbox", G.bbox_polygon("geom"))
    right = spatial.with_point_box(series, "ts_geom")
    near = spatial.knn_join(
        left, right, ["objectid", "ts_metadata_name"], "ts_metadata_id",
        lambda l, r: G.distance_point_polygon(r("ts_geom"), l("geom")),
        by=["ts_metadata_name"], left_cols=["geom", "lbox"])
    return near.join(b.select("objectid", "centroid"), "objectid").select(
        F.col("objectid").alias("bld_objectid"), "ts_metadata_id", "ts_metadata_name", "dist",
        G.make_line("centroid", "ts_geom").alias("geom"))


def touching_neighbours(b: DataFrame, eps: float = TOUCH_EPS) -> DataFrame:
    """Both directions of residential pairs of one municipality whose outlines are within eps."""
    home = spatial.with_polygon_box(b.filter(F.col("building_use") == "Residential"), "geom")
    pairs = spatial.half_pairs(
        home, "id", ["ags", "floor_area", "floor_number", "geom"],
        lambda x, y: G.dwithin_polygons(x("geom"), y("geom"), eps), eps, same=["ags"])
    return spatial.both_directions(pairs.drop("a_geom", "b_geom"))


def neighbour_counts(b: DataFrame, neighbours: DataFrame) -> DataFrame:
    counted = neighbours.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("neighbour_count"))
    return b.join(counted, "id", "left").withColumn("neighbour_count", F.coalesce("neighbour_count", F.lit(0).cast("bigint")))


# ---------------------------------------------------------------- building types



def _similar(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b) < 0.2


def _spread(b: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Give ``label`` to every member of a component that has one already."""
    comp = graph.connected_components(edges)
    reached = graph.propagate_seed(comp, b.filter(F.col("building_type") == label).select("id"))
    marked = reached.select(F.col("node").alias("id"), F.lit(label).alias("__t"))
    return b.join(marked, "id", "left").withColumn(
        "building_type", F.coalesce("__t", "building_type")).drop("__t")


def _edges(neighbours: DataFrame, members: DataFrame, extra: Column | None = None) -> DataFrame:
    ids = members.select("id")
    e = neighbours.filter("a_id < b_id")
    if extra is not None:
        e = e.filter(extra)
    return e.join(ids.withColumnRenamed("id", "a_id"), "a_id", "left_semi").join(
        ids.withColumnRenamed("id", "b_id"), "b_id", "left_semi").select(
        F.col("a_id").alias("source"), F.col("b_id").alias("target"))


def _seed(b: DataFrame, rule: Column, label: str) -> DataFrame:
    free = (F.col("building_use") == "Residential") & F.col("building_type").isNull()
    return b.withColumn("building_type", F.when(free & F.coalesce(rule, F.lit(False)), F.lit(label)).otherwise(
        F.col("building_type")))


def _open_or(label: str, rule: Column | None = None) -> Column:
    untyped = F.col("building_type").isNull() if rule is None else F.col("building_type").isNull() & rule
    return (F.col("building_use") == "Residential") & (untyped | (F.col("building_type") == label))


def classify_type_ab(b: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Apartment blocks: high, large, or built-in with three floors; touching open buildings follow."""
    rule = (F.col("floor_number") >= 4) | (F.col("floor_area") > 1500) | (
        (F.col("floor_number") >= 3) & (F.col("neighbour_count") >= 3))
    seeded = cut_lineage(_seed(b, rule, "AB"))
    return _spread(seeded, _edges(neighbours, seeded.filter(_open_or("AB"))), "AB")


def classify_type_sfh(b: DataFrame, neighbours: DataFrame) -> DataFrame:
    rule = ((F.col("floor_area") < 350) & (F.col("floor_number") <= 3) & (F.col("neighbour_count") == 0)) | (
        (F.col("floor_area") < 200) & (F.col("floor_number") <= 2) & (F.col("neighbour_count") < 2))
    seeded = cut_lineage(_seed(b, rule, "SFH"))
    small = (F.col("floor_area") < 100) & (F.col("floor_number") <= 2)
    return _spread(seeded, _edges(neighbours, seeded.filter(_open_or("SFH", small))), "SFH")


def classify_type_th(b: DataFrame, neighbours: DataFrame) -> DataFrame:
    shape = F.col("floor_area").between(70, 150) & F.col("floor_number").between(2, 3)
    alike = neighbours.filter(_similar(F.col("a_floor_area"), F.col("b_floor_area")))
    with_twin = alike.select(F.col("a_id").alias("id")).distinct().withColumn("__twin", F.lit(True))
    rule = shape & F.col("neighbour_count").between(1, 2) & F.col("__twin")
    seeded = cut_lineage(_seed(b.join(with_twin, "id", "left"), rule, "TH").drop("__twin"))
    same = (F.col("a_floor_number") == F.col("b_floor_number")) & _similar(F.col("a_floor_area"), F.col("b_floor_area"))
    return _spread(seeded, _edges(neighbours, seeded.filter(_open_or("TH", shape)), same), "TH")


def classify_type_mfh(b: DataFrame, neighbours: DataFrame) -> DataFrame:
    rule = F.col("floor_number").between(2, 3) | (
        (F.col("floor_area") > 150) & F.col("neighbour_count").between(1, 3))
    seeded = cut_lineage(_seed(b, rule, "MFH"))
    return _spread(seeded, _edges(neighbours, seeded.filter(_open_or("MFH"))), "MFH")


def classify_types(b: DataFrame, neighbours: DataFrame) -> DataFrame:
    """The four rules in order; ``b`` needs neighbour_count."""
    out = b.withColumn("building_type", F.lit(None).cast("string")) if "building_type" not in b.columns else b
    for step in (classify_type_ab, classify_type_sfh, classify_type_th, classify_type_mfh):
        out = step(out, neighbours)
    return out


def fix_types(b: DataFrame) -> DataFrame:
    """Rest to AB, then correct the types that contradict the number of households."""
    t = F.when((F.col("building_use") == "Residential") & F.col("building_type").isNull(), F.lit("AB")).otherwise(
        F.col("building_type"))
    homes, alone = F.col("households"), F.col("neighbour_count") == 0
    return b.withColumn("building_type", t).withColumn(
        "building_type",
        F.when(F.col("building_type").isin("MFH", "AB") & (homes == 1), F.when(alone, "SFH").otherwise("TH"))
        .when(F.col("building_type").isin("SFH", "TH") & homes.between(2, 4), "MFH")
        .when(F.col("building_type").isin("SFH", "TH") & (homes >= 5), "AB")
        .otherwise(F.col("building_type")))


def census_targets(cells: DataFrame, cell: list[str]) -> DataFrame:
    """Wanted number of buildings per type from the census counts of a cell."""
    c = {n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in TYPE_COLUMNS}
    return cells.select(
        *cell,
        (c["mfh_13undmehrwohnungen"] + c["mfh_7bis12wohnungen"]).alias("target_ab"),
        (c["mfh_3bis6wohnungen"] + c["freist_zfh"]).alias("target_mfh"),
        (c["efh_reihenhaus"] + c["zfh_reihenhaus"] + c["zfh_dhh"] + c["efh_dhh"]).alias("target_th"),
        c["freiefh"].alias("target_sfh"),
        sum(c.values(), F.lit(0)).cast("bigint").alias("total_target"))


def _is(t: str) -> Column:
    return F.col("building_type") == t


# Per stage: target column, extra counts, and the moves as
# (from type, sign of the adjustment, further condition, quota, to type, new households).
def _stage(stage: str):
    hh, adj, rank = F.col("households"), F.col("adjustment"), F.col("rank")
    grown = F.greatest(hh, F.lit(2))
    if stage == "AB":
        pool = F.count_if(_is("MFH") & (hh > 1))
        rest = F.greatest(F.lit(0), adj - F.col("pool"))
        return "target_ab", pool, [
            ("AB", -1, F.lit(True), F.abs(adj), "MFH", grown),
            ("MFH", 1, hh > 1, adj, "AB", grown),
            ("TH", 1, adj >= F.col("pool"), rest, "AB", F.when(rank < rest, grown).otherwise(hh)),
        ]
    if stage == "MFH":
        rest = F.greatest(F.lit(0), adj - F.col("pool"))
        return "target_mfh", F.count_if(_is("TH")), [
            ("MFH", -1, hh <= 2, F.abs(adj), "TH", hh),
            ("TH", 1, F.lit(True), adj, "MFH", grown),
            ("SFH", 1, adj > F.col("pool"), rest, "MFH", grown),
        ]
    if stage == "TH":
        return "target_th", F.count_if(F.lit(False)), [
            ("TH", -1, F.lit(True), F.abs(adj), "SFH", F.lit(1)),
            ("SFH", 1, F.lit(True), adj, "TH", hh),
        ]
    raise ValueError(f"unknown stage {stage!r}")


def rebalance(b: DataFrame, targets: DataFrame, stage: str, cell: list[str]) -> DataFrame:
    """Convert buildings of a cell until its share of a type matches the census.

    Shrinking converts the smallest volumes, growing the largest. The adjustment rounds half up on
    exact integers. Buildings outside every cell keep their type.
    """
    target, pool, moves = _stage(stage)
    group = ["ags", *cell]
    home = b.filter(F.col("building_use") == "Residential").join(targets.select(*cell, target, "total_target"), cell)
    now = home.groupBy(*group).agg(
        F.count_if(_is(stage)).alias("__have"), F.count("*").alias("__all"),
        pool.alias("pool"), F.first(target).alias("__t"), F.first("total_target").alias("__tt"))
    plan = now.filter("__tt > 0").withColumn(
        "adjustment", F.expr("(2 * __t * __all + __tt) div (2 * __tt)") - F.col("__have")).filter(
        "adjustment <> 0").select(*group, "pool", "adjustment")
    candidate = F.lit(False)
    for source, sign, more, _, _, _ in moves:
        candidate = candidate | (_is(source) & (F.signum("adjustment") == sign) & F.coalesce(more, F.lit(False)))
    movers = b.filter(F.col("building_use") == "Residential").join(plan, group).filter(candidate)
    volume = F.col("floor_area") * F.col("height")
    grows = F.col("adjustment") > 0
    # growing: largest first with unknown volumes ahead; shrinking: smallest first, unknown last
    order = [F.when(grows, volume.isNotNull()).otherwise(volume.isNull()),
             F.when(grows, -volume).otherwise(volume), F.col("objectid")]
    ranked = tables.rank_within(
        movers.select("id", "objectid", "building_type", "households", "occupants", "floor_area", "height",
                      "pool", "adjustment", F.struct(*group, "building_type").alias("__g")),
        ["__g"], order)
    new_type, new_homes = F.lit(None).cast("string"), F.lit(None).cast("int")
    for source, sign, more, quota, goal, homes in moves:
        hit = (_is(source) & (F.signum("adjustment") == sign) & F.coalesce(more, F.lit(False)) & (F.col("rank") <= quota))
        new_type = F.when(hit, F.lit(goal)).otherwise(new_type)
        new_homes = F.when(hit, homes.cast("int")).otherwise(new_homes)
    changes = ranked.select("id", "occupants", new_type.alias("__type"), new_homes.alias("__homes")).filter(
        "__type is not null").select(
        "id", "__type", "__homes",
        F.greatest("occupants", "__homes", F.when(F.col("__type") == "AB", F.lit(2)).otherwise(F.lit(1))).alias("__occ"))
    return b.join(changes, "id", "left").withColumns({
        "building_type": F.coalesce("__type", "building_type"),
        "households": F.when(F.col("__type").isNotNull(), F.col("__homes")).otherwise(F.col("households")),
        "occupants": F.when(F.col("__type").isNotNull(), F.col("__occ")).otherwise(F.col("occupants")),
    }).drop("__type", "__homes", "__occ")


def rebalance_all(b: DataFrame, targets: DataFrame, cell: list[str]) -> DataFrame:
    """Apartment blocks first, then multi-family and terraced houses; single houses follow."""
    out = b
    for stage in ("AB", "MFH", "TH"):
        # a stage reads its input several times
        out = cut_lineage(rebalance(out, targets, stage, cell))
    return out


def enrich_buildings(view: DataFrame, surfaces: DataFrame, census: DataFrame, postcodes: DataFrame, use_codes: DataFrame,
                     seed: int = 42, source_srid: int = 3035, cell_size: int = 100) -> DataFrame:
    """The whole enrichment: from flat buildings and surfaces to typed, populated buildings.

    ``view``: feature_id, objectid, ags, building_function_code, height, storeysaboveground, street,
    house_number, geom, centroid. ``census``: x_mp, y_mp and all census columns. ``use_codes``: the list
    of building function codes (code, building_use); a building with a code that is not listed raises.
    """
    base = S.classify_use_by_list(select_buildings(view), "building_function_code", use_codes).withColumns({
        "building_use_id": F.col("building_function_code"), "id": F.col("feature_id")})
    b = drop_low(base).join(ground_area(fill_surface_area(surfaces)), "objectid", "left")
    b = drop_small(b).withColumns({"x": F.col("centroid.x"), "y": F.col("centroid.y")})
    b = cut_lineage(assign_cells(impute_floors(b), cell_size, source_srid))
    cell = ["x_mp", "y_mp"]
    half = cell_size / 2
    used = census.join(b.select("ags", *cell).distinct(), cell).withColumns({
        "xmin": F.col("x_mp") - half, "xmax": F.col("x_mp") + half,
        "ymin": F.col("y_mp") - half, "ymax": F.col("y_mp") + half})
    b = allocate_occupants(b, census, cell)
    b = derive_households(b, census, cell)
    # distances to cells are measured in the grid's own system
    grid_point = crs.transform_point("centroid", source_srid, 3035)
    b = b.withColumns({"x": grid_point["x"], "y": grid_point["y"]})
    b = assign_construction_period(cut_lineage(b), used, cell, seed, by=["ags"])
    b = assign_postcode(b, postcodes)
    b = cut_lineage(b)
    neighbours = cut_lineage(touching_neighbours(b))
    b = classify_types(neighbour_counts(b, neighbours), neighbours)
    b = cut_lineage(fix_types(b))
    return rebalance_all(b, census_targets(census, cell), cell)
