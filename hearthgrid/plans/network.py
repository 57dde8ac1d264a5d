"""Street network: clean, name, merge, filter and split lines, connect buildings, build nodes.

Ways: id, ags, klasse, objektart, geom (line), length_geo. All municipalities run at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, paths, scalar as S
from ..operators import graph, spatial, tables
from ..session import cut_lineage, never_sent

# Fixed tolerances, in metres.
MERGE_TOL, SNAP_TOL, NODE_TOL = 0.20, 0.25, 0.20
NEAR_WAY, END_SNAP = 10.0, 0.15
STREET_RADIUS, WAY_RADIUS, MIN_WAY_DISTANCE, NAME_RADIUS = 100.0, 2000.0, 0.1, 1000.0
# The wide search first looks close by.
WAY_RINGS = (1 / 32, 1 / 8, 1.0)
NAME_RINGS = (1 / 8, 1 / 4, 1.0)
CONNECTOR, SEGMENT = "connection_line", "segmented_way"
# parts of a group that are ordered in the row of the line they join to
PARTS_IN_ROW = 16


def centroid_of_parts(parts) -> Column:
    """Length weighted centre of a collection of lines."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc, part):
        w, c = G.length(part), G.centroid_line(part)
        return F.struct((acc["w"] + w).alias("w"), (acc["x"] + w * c["x"]).alias("x"), (acc["y"] + w * c["y"]).alias("y"))

    return G.let(F.aggregate(G.col(parts), zero, step), lambda t: F.when(
        t["w"] > 0, G.make_point(t["x"] / t["w"], t["y"] / t["w"])).otherwise(F.get(F.get(G.col(parts), 0), 0)))


def longest_part(df: DataFrame, key: str, parts: str, out: str = "geom") -> DataFrame:
    """One usable line per feature: the longest, the earliest of equals."""
    dumped = df.select("*", F.posexplode(parts).alias("__i", out)).drop(parts).filter(G.usable_line(out))
    return tables.first_by(dumped, [key], [-G.length(out), F.col("__i")]).drop("__i")


def filter_ways(ways: DataFrame, classes: list[str] | None = None,
                types_by_class: dict[str, list[str]] | None = None) -> DataFrame:
    """Drop ways outside the class list, or whose type is not allowed for their class; NULLs stay."""
    drop = F.lit(False)
    if classes:
        drop = drop | ~F.col("klasse").isin(*classes)
    if types_by_class:
        allowed = F.lit(False)
        for klasse, types in types_by_class.items():
            allowed = allowed | ((F.col("klasse") == klasse) & F.col("objektart").isin(*types))
        drop = drop | (F.col("klasse").isin(*types_by_class) & ~allowed)
    return ways.filter(~F.coalesce(drop, F.lit(False)))


def clean_ways(lines: DataFrame, areas: DataFrame, classes: list[str] | None = None,
               types_by_class: dict[str, list[str]] | None = None) -> DataFrame:
    """Roads whose centroid lies in a municipality, one line each, filtered by class.

    ``lines``: ogc_fid, klasse, objektart, parts (array<line>); ``areas``: ags, area_geom (polygon).
    """
    placed = spatial.points_in_polygons(
        lines.withColumn("__c", centroid_of_parts("parts")), areas.select("ags", "area_geom"), "__c", "area_geom")
    one = longest_part(placed.drop("__c", "area_geom"), "ogc_fid", "parts")
    out = one.select(F.col("ogc_fid").cast("string").alias("id"), "ags", "klasse", "objektart", "geom",
                     G.length("geom").alias("length_geo"))
    return filter_ways(out, classes, types_by_class)


def named_ways(lines: DataFrame, areas: DataFrame) -> DataFrame:
    """(way, municipality) for every road that meets the municipality."""
    return spatial.spatial_join(
        spatial.with_line_box(lines, "geom"), spatial.with_polygon_box(areas.select("ags", "area_geom"), "area_geom"),
        lambda l, r: G.intersects_line_polygon(l("geom"), r("area_geom"))).drop("area_geom", *spatial.BOX)


def match_address_street(b: DataFrame, named: DataFrame, radius: float = NAME_RADIUS) -> DataFrame:
    """Nearest road within ``radius`` that carries the street name of the address.

    ``b``: id, ags, x, y, street (several separated by ';'); ``named``: way_id, ags, geom, name, name_kurz.
    """
    streets = b.select("id", "ags", "x", "y", F.explode(F.split("street", ";")).alias("__s")).select(
        "id", "ags", "x", "y", S.street_name("__s").alias("__street")).distinct()
    names = named.select("way_id", "ags", "geom", F.explode(F.array_distinct(F.array_compact(F.array("name", "name_kurz")))).alias("__street"))
    # read by every ring; both sides may be results of joins
    best = spatial.nearest_within(cut_lineage(streets), cut_lineage(names), "id", "way_id", "geom", radius, rings=NAME_RINGS, on=["ags", "__street"]).select(
        "id", F.col("way_id").alias("address_street_id"))
    return b.join(best, "id", "left")


def assign_way(b: DataFrame, ways: DataFrame, use_address: bool = True) -> DataFrame:
    """The way of the address when it exists, else the nearest one."""
    roads = ways.filter(F.col("klasse") != CONNECTOR)
    if use_address:
        ids = roads.select(F.col("id").alias("__way"))
        out = b.join(ids, F.col("address_street_id").cast("string") == F.col("__way"), "left")
    else:
        out = b.withColumn("__way", F.lit(None).cast("string"))
    todo = out.filter("__way is null").select("id", "ags", "x", "y")
    near = spatial.nearest_within(
        todo, roads.withColumnRenamed("id", "way_id"), "id", "way_id", "geom", WAY_RADIUS, MIN_WAY_DISTANCE,
        WAY_RINGS, on="ags").select("id", F.col("way_id").alias("__near"))
    return out.join(near, "id", "left").withColumn("assigned_way_id", F.coalesce("__way", "__near")).drop("__way", "__near")


def reassign(b: DataFrame, mapping: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Follow (old_way_id, new_way_id); rows without a new way take the nearest other one."""
    m = mapping.select(F.col("old_way_id").alias("__old"), F.col("new_way_id").alias("__new")).withColumn("__hit", F.lit(True))
    out = b.join(m, F.col("assigned_way_id") == F.col("__old"), "left")
    best = F.col("__new")
    if ways is not None:
        todo = out.filter("__hit and __new is null").select("id", "ags", "x", "y", "assigned_way_id")
        near = spatial.nearest_within(
            todo, ways.filter(F.col("klasse") != CONNECTOR).withColumnRenamed("id", "way_id"), "id", "way_id", "geom",
            WAY_RADIUS, MIN_WAY_DISTANCE, WAY_RINGS, on="ags", exclude=("assigned_way_id", "way_id")).select(
            "id", F.col("way_id").alias("__near"))
        out = out.join(near, "id", "left")
        best = F.coalesce("__new", "__near")
    return out.withColumn("assigned_way_id", F.coalesce(best, F.col("assigned_way_id"))).drop(
        "__old", "__new", "__hit", "__near")


# ---------------------------------------------------------------- merging


def _ends(ways: DataFrame) -> DataFrame:
    """Two rows per way: which end, its point and both end points."""
    return ways.filter(G.usable_line("geom")).select(
        F.col("id").alias("way_id"), "ags", G.start_point("geom").alias("s"), G.end_point("geom").alias("e")
    ).select("way_id", "ags", "s", "e", F.explode(F.array(
        F.struct(F.lit("start").alias("side"), F.col("s.x").alias("x"), F.col("s.y").alias("y")),
        F.struct(F.lit("end").alias("side"), F.col("e.x").alias("x"), F.col("e.y").alias("y")))).alias("p")).select(
        "way_id", "ags", "s", "e", "p.*")


def half_edges(ways: DataFrame) -> DataFrame:
    """One row per place where ways end: place (a number), ags, x, y, halves (way_id, side, s, e of the ends that lie there)."""
    at = _ends(ways).groupBy("ags", "x", "y").agg(F.sort_array(F.collect_list(F.struct("way_id", "side", "s", "e"))).alias("halves"))
    return cut_lineage(at.withColumn("place", F.monotonically_increasing_id()))


def _company(places: DataFrame, tol: float) -> DataFrame | None:
    """The places that may have another one of their municipality within ``tol``; None if there are none.

    A place is counted in the wide cells it reaches into by half the tolerance; two that are near share one. Only counts are
    shuffled, so a crowded cell is nothing special.
    """
    cell, half = 2.0 ** spatial.point_level(8 * tol), 0.51 * tol

    def cells(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - half) / cell), F.floor((F.col(c) + half) / cell)))

    filed = places.select("place", "ags", "y", cells("x").alias("cx")).select("place", "ags", "cx", cells("y").alias("cy"))
    shared = cut_lineage(filed.groupBy("ags", "cx", "cy").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if shared.isEmpty():
        return None
    return places.join(never_sent(filed.join(never_sent(shared), ["ags", "cx", "cy"]).select("place").distinct()), "place", "left_semi")


def _near_places(places: DataFrame, tol: float) -> DataFrame:
    """(place, other) for different places of one municipality at most ``tol`` apart, in both directions."""
    met = _company(places.select("place", "ags", "x", "y"), tol)
    if met is None:
        return places.select("place", F.col("place").alias("other")).limit(0)
    spots = spatial.with_point_box(met, G.make_point("x", "y"))
    pairs = spatial.half_pairs(spots, "place", ["ags", "x", "y"], lambda a, b: G.distance_points(
        G.make_point(a("x"), a("y")), G.make_point(b("x"), b("y"))) <= tol, tol, [spatial.point_level(tol)], same=["ags"])
    return cut_lineage(pairs.select(F.explode(F.array(F.struct(F.col("a_place").alias("place"), F.col("b_place").alias("other")),
                                                      F.struct(F.col("b_place").alias("place"), F.col("a_place").alias("other")))).alias("p")).select("p.*"))


def merge_candidates(ways: DataFrame, tol: float = MERGE_TOL) -> DataFrame:
    """Per way and end: number, sorted ids and nearest of the ways that end within ``tol``.

    The lists come from the places: ends are not paired. The list of an end is a row by definition.
    """
    places = half_edges(ways)
    far = _near_places(places, tol).join(places.select(F.col("place").alias("other"), F.col("halves").alias("far")), "other").groupBy("place").agg(
        F.flatten(F.collect_list("far")).alias("far"))
    around = places.join(far, "place", "left").withColumn("all", F.when(F.col("far").isNull(), F.col("halves")).otherwise(F.concat("halves", "far")))
    here = G.make_point("x", "y")

    def seen(h: Column) -> Column:
        others = F.filter("all", lambda o: o["way_id"] != h["way_id"])
        gaps = F.transform(others, lambda o: F.struct(
            (G.distance_points(o["s"], here) + G.distance_points(o["e"], here)).alias("both"), o["way_id"].alias("id"),
            F.least(G.distance_points(o["s"], here), G.distance_points(o["e"], here)).alias("near")))
        return F.struct(h["way_id"].alias("way_id"), h["side"].alias("side"), F.array_sort(F.array_distinct(F.transform(others, lambda o: o["way_id"]))).alias("ids"),
                        F.array_min(gaps)["id"].alias("nearest"), F.array_min(F.transform(gaps, lambda v: v["near"])).alias("dist"))

    found = around.select(F.explode(F.transform("halves", seen)).alias("h")).select("h.*").filter(F.size("ids") > 0).groupBy("way_id").pivot("side", ["start", "end"]).agg(
        F.first(F.struct("ids", "nearest", "dist")))
    out = ways.filter(G.usable_line("geom")).select(
        F.col("id").alias("way_id"), G.start_point("geom").alias("start_pt"), G.end_point("geom").alias("end_pt")).join(found, "way_id", "left")
    for side in ("start", "end"):
        ids = F.coalesce(F.col(f"{side}.ids"), F.array().cast("array<string>"))
        out = out.withColumns({
            f"{side}_cnt": F.size(ids), f"{side}_neighbor_ids": ids, f"{side}_nearest_id": F.col(f"{side}.nearest"), f"{side}_nearest_dist_m": F.col(f"{side}.dist")}).drop(side)
    return out.withColumn("tol_m", F.lit(tol))


def chain_edges(ways: DataFrame, tol: float = MERGE_TOL) -> DataFrame:
    """Edges u < v between a way end and the only other way that ends there.

    A place is one row with the number of its ways and two of them. Places of three ways and more, and those
    with more than four others nearby (at least three ways), hold no such end; nothing of them is gathered.
    """
    single = _ends(ways).select("ags", "x", "y", "way_id").distinct()
    places = cut_lineage(single.groupBy("ags", "x", "y").agg(
        F.count("*").alias("n"), F.min("way_id").alias("w1"), F.max("way_id").alias("w2")).withColumn("place", F.monotonically_increasing_id()))
    near = _near_places(places, tol)
    two = places.filter("n = 2")
    if near.isEmpty():
        return two.select(F.col("w1").alias("u"), F.col("w2").alias("v")).distinct()
    alone = two.join(never_sent(near.select("place").distinct()), "place", "left_anti").select(F.col("w1").alias("u"), F.col("w2").alias("v"))
    few = near.groupBy("place").agg(F.count("*").alias("k")).filter("k <= 4").select("place")
    others = near.join(never_sent(few), "place").join(never_sent(places.select(F.col("place").alias("other"), F.col("n").alias("m"), F.array("w1", "w2").alias("w"))), "other").groupBy("place").agg(
        F.max("m").alias("m"), F.flatten(F.collect_list("w")).alias("w")).filter("m <= 2").drop("m")
    met = places.filter("n <= 2").join(never_sent(others), "place").withColumn("w", F.array_distinct(F.concat("w", F.array("w1", "w2"))))
    own = met.select("w", F.explode(F.array_distinct(F.array("w1", "w2"))).alias("h")).withColumn("w", F.array_remove("w", F.col("h"))).filter(F.size("w") == 1)
    mixed = own.select(F.least("h", F.get("w", 0)).alias("u"), F.greatest("h", F.get("w", 0)).alias("v"))
    return alone.unionByName(mixed).distinct()


def _places(ends: DataFrame, group: str, tol: float) -> DataFrame:
    """``ends`` (group, x, y, ..) with place: ends of a group that steps of at most ``tol`` connect have one place."""
    spots = cut_lineage(ends.select(group, "x", "y").distinct().withColumn("place", F.struct(group, "x", "y")))
    boxed = spatial.with_point_box(spots, G.make_point("x", "y"))
    near = cut_lineage(spatial.half_pairs(boxed, "place", [group, "x", "y"], lambda a, b: G.distance_points(
        G.make_point(a("x"), a("y")), G.make_point(b("x"), b("y"))) <= tol, tol, same=[group]).select("a_place", "b_place"))
    if near.isEmpty():
        return ends.withColumn("place", F.struct(group, "x", "y"))
    joined = graph.connected_components(near, "a_place", "b_place").select(F.col("node").alias("place"), F.col("component").alias("__c"))
    named = spots.join(never_sent(joined), "place", "left").select(group, "x", "y", F.coalesce("__c", "place").alias("place"))
    return ends.join(never_sent(named), [group, "x", "y"])


def list_ranks(links: DataFrame) -> DataFrame:
    """Order of linked lists by pointer doubling; ``links``: state, next (null at the end of a list), low (any number).

    Columns state, tail (last state of the list), rank (steps to it), low (least low on the way). Every round each state
    looks twice as far, so a list of n states takes log2 n joins and is never gathered. States of a ring have
    no tail; their low is that of the ring.
    """
    at = cut_lineage(links.select("state", F.coalesce("next", "state").alias("tail"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank"),
                                  "low", F.col("next").isNotNull().alias("open")))
    left = at.filter("open").count()
    while left:
        ahead = at.select(F.col("state").alias("tail"), F.col("tail").alias("t2"), F.col("rank").alias("r2"), F.col("low").alias("l2"), F.col("open").alias("o2"))
        moved = at.filter("open").join(never_sent(ahead), "tail").select(
            "state", F.col("t2").alias("tail"), (F.col("rank") + F.col("r2")).alias("rank"), F.least("low", "l2").alias("low"), F.col("o2").alias("open"),
            (F.col("l2") < F.col("low")).alias("news"))
        now = cut_lineage(at.filter("NOT open").withColumn("news", F.lit(False)).unionByName(moved))
        seen = now.agg(F.sum(F.col("open").cast("long")), F.max("news")).first()
        at = now.drop("news")
        # lists close a part of their states every round; what no longer does is rings, which end when nothing lower is met
        if seen[0] == left and not seen[1]:
            break
        left = seen[0]
    return at.select("state", F.when(~F.col("open"), F.col("tail")).alias("tail"), F.when(~F.col("open"), F.col("rank")).alias("rank"), "low")


def ordered_parts(parts: DataFrame, group: str, line: str = "geom", tol: float = SNAP_TOL) -> DataFrame:
    """``parts`` (pid: distinct numbers, group, line) with chain, pos and reverse: their order along lines that join at places
    where exactly two ends of different parts of the group meet.

    A chain starts at the end whose part has the smaller pid, a ring with its smallest pid.
    """
    sided = parts.select(group, "pid", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), G.start_point(line).alias("p")), F.struct(F.lit(1).alias("side"), G.end_point(line).alias("p")))).alias("e")).select(
        group, "pid", "e.side", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))
    placed = _places(sided, group, tol)
    # a place of more than two ends joins nothing: counts and extremes tell, nothing is gathered
    end = F.struct("pid", "side")
    pairs = placed.groupBy(group, "place").agg(F.count("*").alias("n"), F.min(end).alias("a"), F.max(end).alias("b")).filter("n = 2 AND a.pid <> b.pid")
    # a state is a part in one direction (0 as it is, 1 reversed); it leaves at side 1 - direction
    mates = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("m")).select(
        (2 * F.col("m.a.pid") + 1 - F.col("m.a.side")).alias("state"), (2 * F.col("m.b.pid") + F.col("m.b.side")).alias("next"))
    states = parts.select("pid", F.explode(F.array(F.lit(0), F.lit(1))).alias("o")).select((2 * F.col("pid") + F.col("o")).alias("state"), F.col("pid").alias("low"))
    links = cut_lineage(states.join(never_sent(mates), "state", "left"))
    ranks = list_ranks(links)
    rings = ranks.filter("tail IS NULL").select("state", F.col("low").alias("ring"))
    if not rings.isEmpty():
        # a ring is cut in front of its smallest part, and the way back in front of the same place
        cut = links.join(never_sent(rings), "state").select("state", F.when((F.col("next") != 2 * F.col("ring")) & (F.col("state") != 2 * F.col("ring") + 1), F.col("next")).alias("next"), "low")
        ranks = ranks.filter("tail IS NOT NULL").unionByName(list_ranks(cut_lineage(cut)))
    both = ranks.withColumns({"pid": F.shiftright("state", 1), "o": F.col("state") % 2})
    there = both.filter("o = 0").select("pid", F.col("tail").alias("tail0"), F.col("rank").alias("rank0"))
    back = both.filter("o = 1").select("pid", F.col("tail").alias("tail1"), F.col("rank").alias("rank1"))
    # the head of a list is the tail of the opposite list, turned round
    known = there.join(never_sent(back), "pid").withColumns({"first0": F.shiftright("tail1", 1), "last0": F.shiftright("tail0", 1)})
    turned = F.col("first0") > F.col("last0")
    return parts.join(never_sent(known.select("pid", F.least("first0", "last0").alias("chain"), turned.alias("reverse"),
                                              F.when(turned, F.col("rank0")).otherwise(F.col("rank1")).alias("pos"))), "pid")


def _joined(parts: Column, part, at) -> Column:
    """Points of the ``parts`` (array) in order, a place where two meet once; ``part`` and ``at`` give the line and the direction of one."""
    def piece(v: Column, i: Column) -> Column:
        line = part(v)
        path = F.when(at(v), F.reverse(line)).otherwise(line)
        return F.when(i == 0, path).otherwise(F.slice(path, 2, F.greatest(F.size(line) - 1, F.lit(1))))

    return F.flatten(F.transform(parts, piece))


def _merged_at_once(rest: DataFrame, group: str, line: str, tol: float) -> DataFrame:
    """group, v: points of the longest line of groups of few parts, which are ordered in the row of the result."""
    rows = rest.groupBy(group).agg(F.sort_array(F.collect_list(line)).alias("l"))
    steps = rows.withColumn("s", paths.longest_path("l", tol))
    return steps.select(group, _joined(F.col("s"), lambda s: F.get("l", F.shiftright(s, 1)), lambda s: s % 2 == 1).alias("v"))


def _merged_by_joins(rest: DataFrame, group: str, line: str, tol: float) -> DataFrame:
    """The same for any number of parts: they are ordered by joins, only the points of the result come together."""
    # numbers in the order of the parts themselves, however the rows are spread
    parts = cut_lineage(rest.orderBy(group, line).withColumn("pid", F.monotonically_increasing_id()))
    placed = cut_lineage(ordered_parts(parts, group, line, tol))
    sizes = placed.groupBy(group, "chain").agg(F.sum(G.length(line)).alias("len"))
    longest = sizes.groupBy(group).agg(F.min_by("chain", F.struct((-F.col("len")).alias("l"), F.col("chain"))).alias("chain"))
    rows = placed.join(never_sent(longest), [group, "chain"]).groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col(line).alias("l"), "reverse"))).alias("p"))
    return rows.select(group, _joined(F.col("p"), lambda p: p["l"], lambda p: p["reverse"]).alias("v"))


def line_merge(df: DataFrame, group: str, line: str = "geom", tol: float = SNAP_TOL) -> DataFrame:
    """Longest merged line per group (the one with the smallest part, should several be as long).

    Groups of up to ``PARTS_IN_ROW`` parts are ordered in one row each; others, and those with a length that
    is no number, by joins.
    """
    rest = cut_lineage(df.filter((F.size(line) > 1) & F.col(group).isNotNull()).select(group, line))
    odd = ~F.coalesce(G.length(line) < float("inf"), F.lit(False))
    large = cut_lineage(rest.groupBy(group).agg(F.count("*").alias("n"), F.max(odd).alias("odd")).filter((F.col("n") > PARTS_IN_ROW) | F.col("odd")).select(group))
    if large.isEmpty():
        points = _merged_at_once(rest, group, line, tol)
    else:
        points = _merged_at_once(rest.join(never_sent(large), group, "left_anti"), group, line, tol).unionByName(
            _merged_by_joins(rest.join(never_sent(large), group, "left_semi"), group, line, tol))
    kept = points.select(group, F.filter("v", lambda p, i: (i == 0) | (F.get("v", i - 1) != p)).alias(line))
    # a line without length keeps two points
    return kept.withColumn(line, F.when(F.size(line) == 1, F.concat(line, line)).otherwise(F.col(line)))


def merge_chains(ways: DataFrame, tol: float = MERGE_TOL) -> tuple[DataFrame, DataFrame]:
    """Merged network and map old -> new way id. The first member lends its attributes."""
    members = cut_lineage(graph.connected_components(chain_edges(ways, tol), "u", "v", small=True)).select(
        F.col("node").alias("id"), "component")
    # every way once, for the rest, the lines and the attributes
    named = cut_lineage(ways.join(never_sent(members), "id", "left").select(*ways.columns, "component"))
    in_chain = named.filter("component IS NOT NULL")
    attrs = [c for c in ways.columns if c not in ("id", "geom", "length_geo")]
    head = tables.first_by(in_chain.select("component", "id", *attrs), ["component"], [F.col("id")])
    lines = line_merge(in_chain, "component")
    new_id = F.md5(F.concat(F.lit("chain:"), F.col("component")))
    merged = head.drop("id").join(never_sent(lines), "component").withColumn("id", new_id).withColumn(
        "length_geo", G.length("geom")).drop("component")
    rest = named.filter("component IS NULL").drop("component")
    mapping = members.select(F.col("id").alias("old_way_id"), new_id.alias("new_way_id"))
    return rest.unionByName(merged.select(*rest.columns)), mapping


# ---------------------------------------------------------------- filtering and splitting


def filter_ways_topology(ways: DataFrame, min_length: float, loops: bool = True, isolated: bool = True,
                         short: bool = True) -> tuple[DataFrame, DataFrame]:
    """Remaining ways (with length_filter) and the table of removed ones.

    A way is removed as a closed loop, as isolated (no other way within 10 of its ends) or as short
    and connected. A loop hands its length to the nearest way within 10.
    """
    usable = ways.filter(G.usable_line("geom")).withColumns(
        {"is_loop": G.is_closed("geom"), "way_length": G.length("geom")})
    ends = spatial.with_point_box(_ends(ways).select("way_id", "ags", "x", "y"), G.make_point("x", "y"))
    lines = spatial.with_line_box(ways.filter(F.col("geom").isNotNull()).select(
        F.col("id").alias("o_id"), F.col("ags").alias("o_ags"), F.col("geom").alias("o_geom")), "o_geom")
    near = spatial.spatial_join(
        ends, lines, lambda l, r: (l("way_id") != r("o_id")) & (
            G.distance_point_line(G.make_point("x", "y"), r("o_geom")) <= NEAR_WAY),
        NEAR_WAY, [spatial.point_level(NEAR_WAY)], None, on=[("ags", "o_ags")]).select("way_id", "o_id").distinct()
    counts = near.groupBy(F.col("way_id").alias("id")).agg(F.count("*").cast("int").alias("connection_count"))
    judged = usable.join(counts, "id", "left").withColumn("connection_count", F.coalesce("connection_count", F.lit(0)))
    kind = F.when(F.lit(loops) & F.col("is_loop"), "loop").when(
        F.lit(isolated) & (F.col("connection_count") == 0), "isolated").when(
        F.lit(short) & (F.col("way_length") < min_length) & ~F.col("is_loop") & (F.col("connection_count") > 0), "short")
    removed = cut_lineage(judged.withColumn("filter_type", kind).filter("filter_type is not null"))
    loop_lines = spatial.with_line_box(
        removed.filter("filter_type = 'loop'").select("id", "ags", "geom"), "geom")
    heirs = spatial.spatial_join(
        loop_lines, lines, lambda l, r: l("id") != r("o_id"), NEAR_WAY, None, None, on=[("ags", "o_ags")]).withColumn(
        "dist", G.distance_lines("geom", "o_geom")).filter(F.col("dist") <= NEAR_WAY).groupBy("id").agg(
        F.min_by("o_id", F.struct("dist", "o_id")).alias("new_way_id"))
    table = removed.join(heirs, "id", "left").select(
        F.col("id").alias("old_way_id"), "new_way_id", F.col("length_geo").alias("old_length_geo"),
        "filter_type", "connection_count")
    moved = table.filter("new_way_id is not null").groupBy(F.col("new_way_id").alias("id")).agg(
        F.sum("old_length_geo").alias("length_filter"))
    kept = ways.join(removed.select("id"), "id", "left_anti").join(moved, "id", "left")
    return kept, table


def _pieces(ways: DataFrame, cuts: DataFrame, klasse: Column) -> DataFrame:
    """Ways cut at (way_id, f): consecutive cuts are paired by rank, so no way is gathered in one row."""
    bounds = cuts.select("way_id", "f").filter("f > 0 and f < 1").unionByName(
        cuts.select("way_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("f"))).distinct()
    ranked = cut_lineage(tables.rank_within(bounds, ["way_id"], [F.col("f")]))
    spans = ranked.join(
        ranked.select("way_id", F.col("f").alias("f2"), (F.col("rank") - 1).alias("rank")), ["way_id", "rank"])
    # out of a generator: the filter on the length would be pushed below the cut and cut every piece several times
    out = spans.join(ways.withColumnRenamed("id", "way_id"), "way_id").withColumn(
        "geom", F.explode(F.array(G.line_substring("geom", "f", "f2")))).withColumn("length_geo", G.length("geom")).filter("length_geo > 0")
    return out.withColumns({
        "id": F.md5(F.concat_ws(":", "way_id", F.col("rank").cast("string"))),
        "klasse": klasse, "objektart": F.lit(None).cast("string")}).drop("rank", "f", "f2")


def split_at_crossings(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut both ways wherever one meets the inner 1-99 % of another; and the map old -> new."""
    lines = cut_lineage(ways.filter(G.usable_line("geom")).select(
        "id", "ags", "geom", G.line_substring("geom", 0.01, 0.99).alias("inner")).withColumn("no", F.monotonically_increasing_id()))

    def edges(line: str, side: str) -> DataFrame:
        one = lines.select(*[F.col(c).alias(f"{side}_{c}") for c in ("no", "id", "ags")], F.explode(G.segments(line)).alias(f"{side}_s"))
        s = F.col(f"{side}_s")
        return one.withColumns({"xmin": F.least(s["ax"], s["bx"]), "ymin": F.least(s["ay"], s["by"]),
                                "xmax": F.greatest(s["ax"], s["bx"]), "ymax": F.greatest(s["ay"], s["by"])})

    # lines meet where two of their edges do: compared edge by edge, the lines themselves come to the pairs that meet
    pairs = spatial.spatial_join(
        edges("inner", "a"), edges("geom", "b"), lambda l, r: (l("a_id") != r("b_id")) & G.segments_meet(l("a_s"), r("b_s")),
        on=[("a_ags", "b_ags")]).select("a_no", "b_no").distinct()
    first, second = ([F.col(c).alias(f"{side}_{c}") for c in ("no", "id", "geom", "inner")] for side in "ab")
    meets = pairs.join(never_sent(lines.select(*first)), "a_no").join(never_sent(lines.select(*second).drop("b_inner")), "b_no").withColumn(
        "p", F.explode(G.crossing_points("a_inner", "b_geom")))
    edge = 1e-6
    cuts = meets.select(F.explode(F.array(
        F.struct(F.col("a_id").alias("way_id"), G.line_locate("a_geom", "p").alias("f"), G.length("a_geom").alias("len")),
        F.struct(F.col("b_id").alias("way_id"), G.line_locate("b_geom", "p").alias("f"), G.length("b_geom").alias("len"))
    )).alias("c")).select("c.*").filter((F.col("f") * F.col("len") > edge) & ((1 - F.col("f")) * F.col("len") > edge))
    # the same crossing seen from both ways may differ in the last digits
    cuts = cut_lineage(cuts.select("way_id", F.round("f", 9).alias("f")).distinct())
    pieces = cut_lineage(_pieces(ways, cuts, F.col("klasse")))
    rest = ways.join(cuts.select(F.col("way_id").alias("id")).distinct(), "id", "left_anti")
    mapping = pieces.select(F.col("way_id").alias("old_way_id"), F.col("id").alias("new_way_id"), F.col("geom").alias("new_geom"))
    return rest.unionByName(pieces.select(*rest.columns)), mapping


def reassign_to_pieces(b: DataFrame, mapping: DataFrame) -> DataFrame:
    """Buildings on a way that was cut move to its nearest piece."""
    near = b.select("id", "x", "y", "assigned_way_id").join(
        mapping, F.col("assigned_way_id") == F.col("old_way_id")).withColumn(
        "dist", G.distance_point_line(G.make_point("x", "y"), "new_geom")).groupBy("id").agg(
        F.min_by("new_way_id", F.struct("dist", "new_way_id")).alias("__new"))
    return b.join(near, "id", "left").withColumn(
        "assigned_way_id", F.coalesce("__new", "assigned_way_id")).drop("__new")


def connect_buildings(b: DataFrame, ways: DataFrame, count_all: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Connectors, ways with length_connection_line, and the network cut at the connectors.

    Connections that end within 0.15 of a way's end snap to it and do not cut the way; by default
    they do not count towards length_connection_line either.
    """
    w = ways.filter((F.col("klasse") != CONNECTOR) & F.col("geom").isNotNull())
    c = b.filter(F.col("assigned_way_id").isNotNull() & F.col("x").isNotNull()).select(
        F.col("id").alias("building_id"), "x", "y", F.col("assigned_way_id").alias("way_id")).join(
        w.select(F.col("id").alias("way_id"), F.col("ags").alias("way_ags"), F.col("geom").alias("way_geom")), "way_id")
    center = G.make_point("x", "y")
    c = c.withColumn("hit", G.closest_point("way_geom", center))
    at_start = G.distance_points(G.start_point("way_geom"), "hit") < END_SNAP
    at_end = G.distance_points(G.end_point("way_geom"), "hit") < END_SNAP
    c = cut_lineage(c.withColumn("kind", F.when(at_start, "start").when(at_end, "end").otherwise("inner")).withColumns({
        "f": G.line_locate("way_geom", "hit"),
        "geom": G.make_line(center, F.when(F.col("kind") == "start", G.start_point("way_geom")).when(
            F.col("kind") == "end", G.end_point("way_geom")).otherwise(F.col("hit")))}))
    connectors = c.select(
        F.col("way_ags").alias("ags"), F.md5(F.concat_ws(":", F.lit("connector"), F.col("building_id").cast("string"))).alias("id"),
        F.col("way_id").alias("connected_way_id"), F.lit(CONNECTOR).alias("klasse"),
        F.lit(None).cast("string").alias("objektart"), "geom", G.length("geom").alias("length_geo")).filter("length_geo > 0")
    counted = c if count_all else c.filter("kind = 'inner'")
    total = counted.groupBy(F.col("way_id").alias("id")).agg(F.sum(G.length("geom")).alias("length_connection_line"))
    with_sum = ways.join(total, "id", "left")
    cuts = c.filter("kind = 'inner'").select("way_id", "f").distinct()
    cut_ids = cuts.select(F.col("way_id").alias("id")).distinct()
    pieces = _pieces(with_sum, cuts, F.lit(SEGMENT)).withColumn("length_connection_line", F.lit(None).cast("double"))
    network = with_sum.join(cut_ids, "id", "left_anti")
    return connectors, with_sum, network.unionByName(pieces.select(*network.columns))


def assign_way_postcode(ways: DataFrame, postcodes: DataFrame, poly: str = "plz_geom") -> DataFrame:
    """Postcode that holds the longest part of the way (the smallest of equals)."""
    pairs = spatial.spatial_join(
        spatial.with_line_box(ways.filter(G.usable_line("geom")).select("id", "geom"), "geom"),
        spatial.with_polygon_box(postcodes.select("plz", poly), poly),
        lambda l, r: G.intersects_line_polygon(l("geom"), r(poly))).withColumn("__len", G.intersection_length("geom", poly))
    best = pairs.groupBy("id").agg(F.min_by(
        F.col("plz").cast("int"), F.struct(-F.col("__len"), F.col("plz").cast("int"))).alias("postcode"))
    return ways.join(best, "id", "left")


def connector_postcode(connectors: DataFrame, ways: DataFrame) -> DataFrame:
    return connectors.join(ways.select(F.col("id").alias("connected_way_id"), "postcode"), "connected_way_id", "left")


def build_nodes(ways: DataFrame, tol: float = NODE_TOL) -> DataFrame:
    """Way ends clustered by distance: ags, id, geom (mean of the ends), way_ids.

    Ends become places first; the clusters are found over their numbers. The ids of a node are a row by definition.
    """
    places = cut_lineage(_ends(ways).groupBy("x", "y").agg(
        F.collect_set("way_id").alias("w"), F.min("ags").alias("ags"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()))
    placed = places.join(spatial.cluster_places(places, tol), "key", "left").withColumn("component", F.coalesce("component", "key"))
    ends = F.sum("n")
    return placed.groupBy("component").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("way_ids"), F.min("ags").alias("ags"), F.min(F.struct("x", "y")).alias("first"),
        (F.sum(F.col("n") * F.col("x")) / ends).alias("cx"), (F.sum(F.col("n") * F.col("y")) / ends).alias("cy")).select(
        "ags", F.md5(F.concat_ws(":", F.col("first.x").cast("string"), F.col("first.y").cast("string"))).alias("id"),
        G.make_point("cx", "cy").alias("geom"), "way_ids")


def nearest_street(b: DataFrame, streets: DataFrame, radius: float = STREET_RADIUS) -> DataFrame:
    """Nearest street within ``radius`` with distance and connector; ``b``: id, x, y."""
    named = streets.select(F.col("id").alias("street_id"), "geom")
    near = spatial.nearest_within(b, named, "id", "street_id", "geom", radius)
    return near.join(b.select("id", "x", "y"), "id").join(named, "street_id").select(
        F.col("id").alias("building_id"), "street_id", F.col("dist").alias("nearest_distance"),
        G.shortest_line_point(G.make_point("x", "y"), "geom").alias("geom"))


def nearest_street_of_outline(b: DataFrame, streets: DataFrame, radius: float = STREET_RADIUS) -> DataFrame:
    """The same for building outlines: ``b`` has id and geom (polygon)."""
    left = spatial.with_polygon_box(b.select("id", F.col("geom").alias("outline")), "outline")
    right = spatial.with_line_box(streets.select(F.col("id").alias("street_id"), "geom"), "geom")
    pairs = spatial.spatial_join(left, right, None, radius).withColumn(
        "dist", F.when(G.intersects_line_polygon("geom", "outline"), F.lit(0.0)).otherwise(
            G.distance_lines(F.get("outline", 0), "geom"))).filter(F.col("dist") <= radius)
    best = pairs.groupBy("id").agg(F.min_by(
        F.struct("street_id", "dist", "outline", "geom"), F.struct("dist", "street_id")).alias("m")).select("id", "m.*")
    return best.select(F.col("id").alias("building_id"), "street_id", F.col("dist").alias("nearest_distance"),
                       G.shortest_line_lines(F.get("outline", 0), "geom").alias("geom"))


def build_network(lines: DataFrame, areas: DataFrame, buildings: DataFrame, postcodes: DataFrame,
                  min_length: float = 5.0, classes: list[str] | None = None,
                  types_by_class: dict[str, list[str]] | None = None, use_address: bool = False) -> dict[str, DataFrame]:
    """All steps in order: ways, connected ways, connectors, both node tables and the buildings."""
    ways = cut_lineage(clean_ways(lines, areas, classes, types_by_class))
    b = cut_lineage(assign_way(buildings, ways, use_address))
    ways, renamed = merge_chains(ways)
    ways = cut_lineage(ways)
    b = cut_lineage(reassign(b, renamed))
    ways, removed = filter_ways_topology(ways, min_length)
    ways = cut_lineage(ways)
    b = cut_lineage(reassign(b, removed, ways))
    ways, pieces = split_at_crossings(ways)
    ways = cut_lineage(ways)
    b = cut_lineage(reassign_to_pieces(b, pieces))
    connectors, ways, network = connect_buildings(b, ways)
    ways = cut_lineage(assign_way_postcode(ways, postcodes))
    network = assign_way_postcode(network, postcodes)
    return {
        "ways_per_junction": ways, "ways_per_connection": network,
        "connection_lines": connector_postcode(connectors, ways),
        "nodes_per_junction": build_nodes(ways), "nodes_per_connection": build_nodes(network), "buildings": b,
    }
