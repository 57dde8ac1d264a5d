"""Overlay of polygons and lines with the union of areas.

Everything is rows of directed edges with the inside on their left. Edges that meet are found cell by cell
(``spatial_join``) and cut at common points, so that afterwards edges either are equal or share nothing
but ends. Equal pieces of different owners meet as one *arc*; what lies left and right of an arc
follows from the owners' directions, and for areas that do not own it from one point-in-polygon test of its middle. The
boundary of a union or an intersection is the arcs with the inside on one side only. Its arcs are
joined into rings per feature, across all cells; edges inside the union never reach the result.

Places closer than ``TOLERANCE`` count as one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..session import cut_lineage, ship_package
from . import cover, spatial

TOLERANCE = 1e-7
_ENDS = ["ax", "ay", "bx", "by"]
# results that a Python task holds at once
_STITCHED = 500
_MULTI = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def directed_edges(df: DataFrame, rings: str, *keys: str) -> DataFrame:
    """Columns keys, ax, ay, bx, by of all edges of ``rings`` (array<polygon>), the inside on their left.

    Shells run against the clock, holes with it; rings given the other way are turned round.
    """
    one = df.select(*keys, F.explode(rings).alias("__p")).select(*keys, F.posexplode("__p").alias("__r", "__ring"))
    twice = F.aggregate(G.segments("__ring"), F.lit(0.0), lambda acc, s: acc + s["ax"] * s["by"] - s["bx"] * s["ay"])
    turn = (twice < 0) != (F.col("__r") > 0)
    edges = one.withColumn("__t", turn).select(*keys, "__t", F.explode(G.segments("__ring")).alias("__s"))
    pick = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    return edges.select(*keys, *[F.when(F.col("__t"), F.col(f"__s.{pick[c]}")).otherwise(F.col(f"__s.{c}")).alias(c) for c in _ENDS]).filter(
        "ax <> bx OR ay <> by")


def _boxed(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"xmin": F.least("ax", "bx"), "ymin": F.least("ay", "by"), "xmax": F.greatest("ax", "bx"), "ymax": F.greatest("ay", "by")})


def _upright(s: str) -> dict[str, Column]:
    """The edge from its smaller to its larger end, so equal edges give equal numbers."""
    turned = (F.col(f"{s}ax") > F.col(f"{s}bx")) | ((F.col(f"{s}ax") == F.col(f"{s}bx")) & (F.col(f"{s}ay") > F.col(f"{s}by")))
    other = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    return {c: F.when(turned, F.col(f"{s}{other[c]}")).otherwise(F.col(f"{s}{c}")) for c in _ENDS}


def common_points(p: str, q: str) -> Column:
    """array<point> of the places that edges with column prefixes ``p`` and ``q`` share: ends on the other edge, or else the crossing."""
    e, f = _upright(p), _upright(q)
    first = F.struct(*[e[c].alias(c) for c in _ENDS])
    second = F.struct(*[f[c].alias(c) for c in _ENDS])

    def points(pair: Column) -> Column:
        a, b = pair["lo"], pair["hi"]

        def on(s: Column, x: Column, y: Column) -> Column:
            dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
            t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - s["ax"]) * dx + (y - s["ay"]) * dy) / (dx * dx + dy * dy)))
            gx, gy = s["ax"] + t * dx - x, s["ay"] + t * dy - y
            return gx * gx + gy * gy <= TOLERANCE * TOLERANCE

        ends = F.filter(F.array(*[F.when(on(s, o[x], o[y]), G.make_point(o[x], o[y])) for s, o in ((a, b), (b, a)) for x, y in (("ax", "ay"), ("bx", "by"))]),
                        lambda v: v.isNotNull())
        ux, uy, vx, vy = a["bx"] - a["ax"], a["by"] - a["ay"], b["bx"] - b["ax"], b["by"] - b["ay"]
        d = ux * vy - uy * vx
        safe = F.when(d == 0, F.lit(1.0)).otherwise(d)
        t = ((b["ax"] - a["ax"]) * vy - (b["ay"] - a["ay"]) * vx) / safe
        u = ((b["ax"] - a["ax"]) * uy - (b["ay"] - a["ay"]) * ux) / safe
        cross = F.when((d != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1), F.array(G.make_point(a["ax"] + t * ux, a["ay"] + t * uy))).otherwise(
            F.array().cast(f"array<{G.POINT}>"))
        return F.when(F.size(ends) > 0, F.array_distinct(ends)).otherwise(cross)

    return G.let(F.struct(F.least(first, second).alias("lo"), F.greatest(first, second).alias("hi")), points)


def split_edges(edges: DataFrame, nodes: DataFrame, *key: str) -> DataFrame:
    """``edges`` (key and other columns, ax .. by) cut at the points of ``nodes`` (key, p); adds own_start: the start is an end of the edge."""
    at = nodes.groupBy(*key).agg(F.collect_set("p").alias("__at"))
    joined = edges.join(at, list(key), "left")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    a, b = G.make_point("ax", "ay"), G.make_point("bx", "by")
    inner = F.filter(F.coalesce("__at", F.array().cast(f"array<{G.POINT}>")), lambda p: (p != a) & (p != b))
    placed = F.array_sort(F.transform(inner, lambda p: F.struct(((p["x"] - F.col("ax")) * dx + (p["y"] - F.col("ay")) * dy).alias("t"), p.alias("p"))))
    path = F.concat(F.array(a), F.transform(placed, lambda v: v["p"]), F.array(b))
    arcs = F.transform(G.segments(path), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    kept = [c for c in edges.columns if c not in _ENDS]
    return joined.select(*kept, F.explode(arcs).alias("__a")).select(
        *kept, *[F.col(f"__a.s.{c}").alias(c) for c in _ENDS], (F.col("__a.i") == 0).alias("own_start"))


def _arcs(edges: DataFrame) -> DataFrame:
    """Edges by their canonical direction: adds ``forward`` (the edge runs that way) and replaces the ends."""
    up = _upright("")
    forward = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    rest = [c for c in edges.columns if c not in _ENDS]
    return edges.select(*rest, forward.alias("forward"), *[v.alias(c) for c, v in up.items()])


def _middle() -> tuple[Column, Column]:
    return (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2


def _one_sided(left: Column, right: Column, df: DataFrame, *keep: str) -> DataFrame:
    """Arcs with the inside on one side, directed so that it lies on the left."""
    other = {"ax": "bx", "ay": "by", "bx": "ax", "by": "ay"}
    kept = df.withColumns({"__l": left, "__r": right}).filter("__l <> __r")
    return kept.select(*keep, *[F.when(F.col("__l"), F.col(c)).otherwise(F.col(other[c])).alias(c) for c in _ENDS])


def _outline(areas: DataFrame, poly: str) -> tuple[DataFrame, DataFrame]:
    """Boundary of the union (owner, ax, ay, bx, by; the inside on the left), and the pairs of areas that meet (a, b)."""
    rows = cut_lineage(areas.select(poly).filter(F.col(poly).isNotNull()).distinct().withColumn("aid", F.monotonically_increasing_id()))
    edges = cut_lineage(directed_edges(rows.withColumn("__m", F.array(poly)), "__m", "aid").withColumn("eid", F.monotonically_increasing_id()))
    pairs = spatial.half_pairs(_boxed(edges), "eid", ["aid", *_ENDS], lambda a, b: a("aid") != b("aid"), TOLERANCE)
    met = cut_lineage(pairs.withColumn("p", F.explode(common_points("a_", "b_"))))
    nodes = met.select(F.col("a_eid").alias("eid"), "p").unionByName(met.select(F.col("b_eid").alias("eid"), "p"))
    pieces = _arcs(split_edges(edges, nodes, "eid").drop("eid", "own_start"))
    arcs = cut_lineage(pieces.groupBy(*_ENDS).agg(
        F.collect_set("aid").alias("owners"), F.max("forward").alias("left"), F.max(~F.col("forward")).alias("right")).filter("left <> right"))
    cells = cut_lineage(cover.cover_edges(edges.select("aid", *_ENDS), "aid"))
    inner = cover.points_in_cover(arcs, cells, *_middle()).filter("NOT array_contains(owners, aid)").select(*_ENDS).distinct()
    bound = arcs.join(inner, _ENDS, "left_anti").withColumn("owner", F.array_min("owners"))
    links = met.select(F.col("a_aid").alias("a"), F.col("b_aid").alias("b")).distinct()
    return cut_lineage(_one_sided(F.col("left"), F.col("right"), bound, "owner")), links


def union_edges(areas: DataFrame, poly: str) -> DataFrame:
    """Boundary of the union of all areas: edges ax, ay, bx, by with the inside on the left, stored.

    Areas may overlap, touch, share borders, contain each other or repeat. Inner edges are gone; nothing is said
    about the order of the edges.
    """
    return _outline(areas, poly)[0].select(*_ENDS)


# ---------------------------------------------------------------- rings


def _turning(arrive: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Angles of leaving directions, clockwise from the way back."""
    back = math.atan2(-arrive[1], -arrive[0])
    return np.mod(back - np.arctan2(leave[:, 1], leave[:, 0]) - 1e-12, 2 * math.pi)


def rings_of(edges: np.ndarray, own_start: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed edges (n x 4); where several leave a place, the inside on the left decides.

    Places within twice the tolerance are one. A place on a straight line goes if it was only a cut.
    """
    ends = edges.reshape(-1, 2)
    grid = np.round(ends / (4 * TOLERANCE)).astype(np.int64)
    name: dict[tuple[int, int], int] = {}
    where, node = [], np.empty(len(ends), dtype=np.int64)
    for k, (gx, gy) in enumerate(grid.tolist()):
        hit = next((v for i in (0, -1, 1) for j in (0, -1, 1) if (v := name.get((gx + i, gy + j))) is not None
                    and np.abs(where[v] - ends[k]).max() <= 2 * TOLERANCE), None)
        if hit is None:
            hit = len(where)
            where.append(ends[k])
        name.setdefault((gx, gy), hit)
        node[k] = hit
    place = np.array(where)
    start, end = node[::2], node[1::2]
    real = start != end
    start, end, own_start = start[real], end[real], own_start[real]
    leaving: dict[int, list[int]] = {}
    for k, s in enumerate(start.tolist()):
        leaving.setdefault(s, []).append(k)
    direction = place[end] - place[start]
    free, out = np.ones(len(start), dtype=bool), []
    for first in range(len(start)):
        path, k = [], first
        while free[k]:
            free[k] = False
            path.append(k)
            options = [o for o in leaving.get(int(end[k]), ()) if free[o] or o == first]
            if not options:
                break
            k = options[0] if len(options) == 1 else options[int(np.argmin(_turning(direction[k], direction[options])))]
        if len(path) < 3 or end[path[-1]] != start[first]:
            continue
        ring, keep = np.array(path), []
        before = direction[np.roll(ring, 1)]
        for i, k in enumerate(ring):
            d, b = direction[k], before[i]
            straight = abs(b[0] * d[1] - b[1] * d[0]) <= 4 * TOLERANCE * math.hypot(*(d + b)) and b @ d > 0
            if own_start[k] or not straight:
                keep.append(start[k])
        if len(keep) >= 3:
            out.append(place[[*keep, keep[0]]])
    return out


def _signed(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    (ax, ay), (bx, by) = ring[:-1].T, ring[1:].T
    hit = (ay > p[1]) != (by > p[1])
    return bool((p[0] < ax[hit] + (p[1] - ay[hit]) * (bx[hit] - ax[hit]) / (by[hit] - ay[hit])).sum() % 2)


def polygons_of(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Shells with their holes; a hole belongs to the smallest shell around it."""
    sized = [(r, _signed(r)) for r in rings]
    shells = sorted([(a, r) for r, a in sized if a > TOLERANCE * TOLERANCE], key=lambda s: s[0])
    out: list[list[np.ndarray]] = [[r] for _, r in shells]
    for hole, a in sized:
        if a < -TOLERANCE * TOLERANCE:
            inside = (hole[0] + hole[1]) / 2
            home = next((k for k, (_, r) in enumerate(shells) if _holds(r, inside)), None)
            if home is not None:
                out[home].append(hole)
    return out


def stitch(arcs: DataFrame, key: str, geom: str) -> DataFrame:
    """key, ``geom`` (multi polygon) of the directed edges of each key; an empty result drops out.

    The edges of a key become one row, as its result is; Python takes batches of rows, no group of its own per key.
    """
    ship_package(arcs.sparkSession)
    kind = arcs.schema[key].dataType.simpleString()

    def join(batches):
        for part in (batch.slice(k, _STITCHED) for batch in batches for k in range(0, batch.num_rows, _STITCHED)):
            lists = part.column(1)
            # the values may be part of a longer array
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            edges = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in _ENDS]).astype(float)
            own = flat.field("own_start").to_numpy(zero_copy_only=False).astype(bool)
            multis = [[[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in poly] for poly in polygons_of(rings_of(edges[i:j], own[i:j]))]
                      for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            kept = [k for k, multi in enumerate(multis) if multi]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(kept, pa.int64())), pa.array([multis[k] for k in kept], _MULTI)], names=[key, geom])

    rows = arcs.groupBy(key).agg(F.collect_list(F.struct(*_ENDS, "own_start")).alias("__arcs"))
    return rows.mapInArrow(join, f"{key} {kind}, {geom} {G.MULTI}")


def dissolve(areas: DataFrame, poly: str) -> DataFrame:
    """The union of all areas without inner edges: one multi polygon (column ``poly``) per set of areas that meet.

    A set that meets is one geometry, hence one row and one group. Places on a straight border go.
    """
    from .graph import connected_components

    bound, links = _outline(areas, poly)
    sets = connected_components(links, "a", "b").select(F.col("node").alias("owner"), "component")
    named = bound.join(sets, "owner", "left").select(F.coalesce("component", "owner").alias("component"), *_ENDS, F.lit(False).alias("own_start"))
    return stitch(named, "component", poly).select(poly)


# ---------------------------------------------------------------- clipping


def clip_multi(df: DataFrame, geom: str, areas: DataFrame, poly: str) -> DataFrame:
    """Multi polygons cut to the union of the areas: one geometry per row without inner edges, rows outside drop out.

    Rows that no boundary of the union comes near pass as they are, inside, or go, outside. Equal rows stay
    apart. Null geometries drop out; no areas give no rows.
    """
    bound = union_edges(areas, poly)
    whole = cut_lineage(cover.cover_edges(bound.withColumn("__u", F.lit(0)), "__u"))
    keyed = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    boxed = spatial.with_box(keyed.select("__id", geom).filter(F.size(geom) > 0), G.bbox_multi(geom))
    edged = cut_lineage(_boxed(bound).withColumn("__e", F.monotonically_increasing_id()))
    near = cut_lineage(spatial.spatial_join(boxed.select("__id", *spatial.BOX), edged.select("__e", *spatial.BOX), eps=TOLERANCE).select("__id", "__e"))
    cut_ids = near.select("__id").distinct()
    # features that no boundary comes near: one corner decides
    first = F.get(F.get(F.get(geom, 0), 0), 0)
    apart = boxed.join(cut_ids, "__id", "left_anti").select("__id", first["x"].alias("__x"), first["y"].alias("__y"))
    inside = cover.points_in_cover(apart, whole, F.col("__x"), F.col("__y")).select("__id")
    passed = keyed.join(inside, "__id", "left_semi").drop("__id")

    cut = boxed.join(cut_ids, "__id", "left_semi").select("__id", geom)
    own = cut_lineage(directed_edges(cut, geom, "__id").withColumn("__f", F.monotonically_increasing_id()))
    left = _boxed(own).withColumnsRenamed({c: f"f_{c}" for c in _ENDS})
    right = edged.withColumnsRenamed({c: f"u_{c}" for c in _ENDS})
    met = cut_lineage(spatial.spatial_join(left, right, eps=TOLERANCE).withColumn("p", F.explode(common_points("f_", "u_"))).select("__id", "__f", "__e", "p"))
    mine = split_edges(own, met, "__f").select("__id", *_ENDS, "own_start", F.lit(True).alias("feature"))
    # the ends of the union's edges may be cuts of an area's border: they count as corners where it turns
    theirs = split_edges(near.join(edged.select("__e", *_ENDS), "__e"), met, "__id", "__e").select(
        "__id", *_ENDS, F.lit(False).alias("own_start"), F.lit(False).alias("feature"))
    sides = _arcs(mine.unionByName(theirs))

    def has(feature: bool, forward: bool) -> Column:
        return F.max((F.col("feature") == feature) & (F.col("forward") == forward))

    # an end of an edge at the lower or the upper end of the arc
    arcs = cut_lineage(sides.groupBy("__id", *_ENDS).agg(
        has(True, True).alias("fl"), has(True, False).alias("fr"), has(False, True).alias("ul"), has(False, False).alias("ur"),
        F.max(F.col("own_start") & F.col("forward")).alias("low_end"), F.max(F.col("own_start") & ~F.col("forward")).alias("high_end")))
    x, y = _middle()
    cells = cut_lineage(cover.cover_edges(own.select("__id", *_ENDS).withColumnRenamed("__id", "__fid"), "__fid"))
    foreign = arcs.filter("NOT fl AND NOT fr")
    in_feature = cover.points_in_cover(foreign, cells, x, y, on=[("__id", "__fid")]).select("__id", *_ENDS).withColumn("in_f", F.lit(True))
    in_union = cover.points_in_cover(arcs.filter("NOT ul AND NOT ur"), whole, x, y).select("__id", *_ENDS).withColumn("in_u", F.lit(True))
    known = arcs.join(in_feature, ["__id", *_ENDS], "left").join(in_union, ["__id", *_ENDS], "left").na.fill(False, ["in_f", "in_u"])
    l = (F.col("fl") | F.col("in_f")) & (F.col("ul") | F.col("in_u"))
    r = (F.col("fr") | F.col("in_f")) & (F.col("ur") | F.col("in_u"))
    result = _one_sided(l, r, known.withColumn("own_start", F.when(l, F.col("low_end")).otherwise(F.col("high_end"))), "__id", "own_start")
    made = stitch(result, "__id", "__g")
    clipped = keyed.drop(geom).join(made, "__id").withColumn(geom, F.col("__g")).select(*df.columns)
    return passed.select(*df.columns).unionByName(clipped)


def clip_lines(df: DataFrame, geom: str, areas: DataFrame, poly: str) -> DataFrame:
    """One row per connected piece of a line in the union of the areas, borders included; pieces keep the other columns.

    A line along a border of two areas, or inside both, counts once. Lines that only touch an area drop out.
    """
    bound = cut_lineage(_boxed(union_edges(areas, poly)).withColumn("__e", F.monotonically_increasing_id()))
    whole = cut_lineage(cover.cover_edges(bound.select(F.lit(0).alias("__u"), *_ENDS), "__u"))
    keyed = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    edges = keyed.select("__id", F.posexplode(G.segments(geom)).alias("__k", "__s")).select(
        "__id", "__k", *[F.col(f"__s.{c}").alias(c) for c in _ENDS]).filter("ax <> bx OR ay <> by")
    left = _boxed(edges).withColumnsRenamed({c: f"f_{c}" for c in _ENDS})
    right = bound.withColumnsRenamed({c: f"u_{c}" for c in _ENDS})
    met = cut_lineage(spatial.spatial_join(left, right, eps=TOLERANCE).withColumn("__p", common_points("f_", "u_")).filter("size(__p) > 0").select(
        "__id", "__k", F.explode("__p").alias("p"), F.when(F.size("__p") > 1, F.col("__p")).alias("along")))
    pieces = split_edges(edges, met.select("__id", "__k", "p"), "__id", "__k").withColumn("__o", F.monotonically_increasing_id())
    # two common points of a line's edge and a border: the stretch between them runs along the border
    along = met.filter("along IS NOT NULL").select("__id", "__k", F.get("along", 0).alias("p"), F.get("along", F.size("along") - 1).alias("q")).distinct()
    pieces = cut_lineage(pieces)
    x, y = _middle()
    inner = cover.points_in_cover(pieces, whole, x, y, boundary=True).select("__id", "__k", "__o")
    near = (x >= F.least("p.x", "q.x") - TOLERANCE) & (x <= F.greatest("p.x", "q.x") + TOLERANCE) & (
        y >= F.least("p.y", "q.y") - TOLERANCE) & (y <= F.greatest("p.y", "q.y") + TOLERANCE)
    border = pieces.join(along, ["__id", "__k"]).filter(near).select("__id", "__k", "__o")
    kept = pieces.join(inner.unionByName(border).distinct(), ["__id", "__k", "__o"])
    # one line: pieces that follow each other are one
    row = Window.partitionBy("__id").orderBy("__k", "__o")
    joined = kept.withColumn("__new", (~(F.lag("bx").over(row).eqNullSafe(F.col("ax")) & F.lag("by").over(row).eqNullSafe(F.col("ay")))).cast("int")).withColumn(
        "__run", F.sum("__new").over(row))
    lines = joined.groupBy("__id", "__run").agg(F.sort_array(F.collect_list(F.struct("__k", "__o", *_ENDS))).alias("v")).select(
        "__id", F.concat(F.array(G.make_point(F.get("v", 0)["ax"], F.get("v", 0)["ay"])),
                         F.transform("v", lambda s: G.make_point(s["bx"], s["by"]))).alias("__g"))
    return keyed.drop(geom).join(lines, "__id").withColumn(geom, F.col("__g")).select(*df.columns)
