"""Cells that cover polygons, as the filing structure of point-in-polygon joins.

A polygon becomes rows of cells. A *full* cell lies inside as a whole: a point in it needs no test.
A *partial* cell meets the boundary and carries only the edges that touch it, and whether its lower right
corner is inside. A point of a partial cell walks to that corner, along its height to the right border and down
the border, and counts the edges it crosses; none of them lies outside the cell. The ring is never read
again, and a polygon of any number of vertices spreads over as many cells as it has edges.

Full cells are merged four by four, twice at most, into cells of coarser levels. Levels are even, so points
are filed at few levels. The grid is shifted by an odd fraction: coordinates in whole numbers do not
come to lie on its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..session import cut_lineage

SHIFT = 0.3819660112501051
#: log2 of the cells along the longer side of a polygon: at least, at most
LEAST_SPLITS, MOST_SPLITS, MERGES = 3, 12, 2
_SLACK = 1e-6  # of a cell: edges this close to a cell count as touching it
_EDGE = ("ax", "ay", "bx", "by")


def polygon_edges(df: DataFrame, poly: str, *keys: str) -> DataFrame:
    """Columns keys, ax, ay, bx, by: one row per edge of every ring; null polygons have none."""
    return df.select(*keys, F.explode(G.polygon_segments(poly)).alias("__s")).select(*keys, *[F.col(f"__s.{c}").alias(c) for c in _EDGE])


def _size(level: str = "lv") -> str:
    return f"pow(2D, {level})"


def cover_edges(edges: DataFrame, key: str, least_splits: int = LEAST_SPLITS, merges: int = MERGES) -> DataFrame:
    """Cells of the areas that ``edges`` (key, ax, ay, bx, by) bound by the even-odd rule.

    Columns key, lv, cx, cy, odd (the lower right corner is inside; null for full cells), edges (null for full cells).
    """
    span = edges.groupBy(key).agg(
        F.count("*").alias("n"), *[F.min(F.least(f"a{c}", f"b{c}")).alias(f"{c}min") for c in "xy"], *[F.max(F.greatest(f"a{c}", f"b{c}")).alias(f"{c}max") for c in "xy"])
    # about four cells an edge in the box: a long narrow box takes more along its longer side
    longer, shorter = "greatest(xmax - xmin, ymax - ymin, 1e-3)", "greatest(least(xmax - xmin, ymax - ymin), 1e-3)"
    level = span.selectExpr(key, f"""2 * cast(floor((ceil(log2({longer}))
        - least({MOST_SPLITS}, greatest({least_splits}, ceil(log2(4D * n * {longer} / {shorter}) / 2)))) / 2) as int) AS lv""")
    u = {c: f"(({c} - {SHIFT}) / {_size()})" for c in _EDGE}
    rows = edges.join(level, key).selectExpr("*", *[f"{v} AS u_{c}" for c, v in u.items()]).selectExpr(
        "*", f"explode(sequence(floor(least(u_ay, u_by) - {_SLACK}), floor(greatest(u_ay, u_by) + {_SLACK}))) AS cy").repartition(key, "lv", "cy")

    def at(v: str) -> str:  # abscissa in cells at a height, kept inside the edge
        t = f"(least(greatest({v}, least(u_ay, u_by)), greatest(u_ay, u_by)) - u_ay) / (u_by - u_ay)"
        return f"(u_ax + (u_bx - u_ax) * {t})"

    flat = "u_ay = u_by"
    lo, hi = (f"CASE WHEN {flat} THEN {f}(u_ax, u_bx) ELSE {f}({at(f'cy - {_SLACK}')}, {at(f'cy + 1 + {_SLACK}')}) END" for f in ("least", "greatest"))
    bottom = f"(cy * {_size()} + {SHIFT})"
    crossing = f"CASE WHEN (ay > {bottom}) <> (by > {bottom}) THEN floor((ax + ({bottom} - ay) * (bx - ax) / (by - ay) - {SHIFT}) / {_size()}) END"
    touched = rows.selectExpr(key, "lv", "cy", *_EDGE, f"{crossing} AS crossed",
                              f"explode(sequence(floor({lo} - {_SLACK}), floor({hi} + {_SLACK}))) AS cx")
    # an edge crosses the bottom line of a cell row in one column; the rows of cells are dealt out once for all that follows
    partial = touched.groupBy(key, "lv", "cx", "cy").agg(
        F.collect_list(F.struct(*_EDGE)).alias("edges"), F.sum((F.col("crossed") == F.col("cx")).cast("int")).alias("crossings"))
    # one cell row of one polygon: edges crossed to the right of a corner, and the next cell with edges
    row = Window.partitionBy(key, "lv", "cy").orderBy(F.col("cx").desc())
    scanned = cut_lineage(partial.withColumn("right", F.coalesce(F.sum("crossings").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "next", F.lag("cx").over(row)).withColumn("odd", F.col("right") % 2 == 1))
    full = scanned.filter("odd AND next > cx + 1").select(key, "lv", F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy")
    kept = None
    for _ in range(merges):
        block = Window.partitionBy(key, "lv", F.floor(F.col("cx") / 4), F.floor(F.col("cy") / 4))
        counted = full.withColumn("n", F.count("*").over(block))
        rest = counted.filter("n < 16").drop("n")
        kept = rest if kept is None else kept.unionByName(rest)
        full = counted.filter("n = 16 AND pmod(cx, 4) = 0 AND pmod(cy, 4) = 0").selectExpr(key, "lv + 2 AS lv", "floor(cx / 4) AS cx", "floor(cy / 4) AS cy")
    kept = full if kept is None else kept.unionByName(full)
    none = kept.withColumns({"odd": F.lit(None).cast("boolean"), "edges": F.lit(None).cast("array<struct<ax:double,ay:double,bx:double,by:double>>")})
    return scanned.select(key, "lv", "cx", "cy", "odd", "edges").unionByName(none)


def _side(s: Column, x: Column, y: Column) -> Column:
    """Side of the line through an edge; a place on the line counts as just above it, as it does for the ends of edges."""
    a, b = (x - s["ax"]) * (s["by"] - s["ay"]), (s["bx"] - s["ax"]) * (y - s["ay"])
    return (a < b) | ((a == b) & (s["bx"] > s["ax"]))


def _in_partial(x: Column, y: Column, boundary: bool) -> Column:
    size = F.pow(F.lit(2.0), F.col("__lv"))
    right, bottom = (F.col("__cx") + 1) * size + SHIFT, F.col("__cy") * size + SHIFT

    def crossed(s: Column) -> Column:
        here, border, corner = _side(s, x, y), _side(s, right, y), _side(s, right, bottom)
        along = ((s["ay"] > y) != (s["by"] > y)) & (here != border)
        down = ((s["ax"] > right) != (s["bx"] > right)) & (border != corner)
        return along != down

    inside = F.aggregate("__edges", F.col("__odd"), lambda acc, s: acc != crossed(s))
    on_edge = F.exists("__edges", lambda s: (
        ((s["bx"] - s["ax"]) * (y - s["ay"]) == (s["by"] - s["ay"]) * (x - s["ax"]))
        & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))))
    return inside | on_edge if boundary else inside & ~on_edge


def points_in_cover(points: DataFrame, cover: DataFrame, x: Column, y: Column, boundary: bool = False,
                    on: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows of ``points`` with the other columns of ``cover`` (see ``cover_edges``), one per area that holds the point.

    ``boundary`` tells whether points on an edge are inside; ``on`` adds pairs of columns that must be equal. The cover should be a stored table: then a small one is
    broadcast and a crowded cell is an ordinary skewed key.
    """
    levels = sorted(r["lv"] for r in cover.select("lv").distinct().collect())  # at most one per even power of two
    names = {c: f"__{c}" for c in ("lv", "cx", "cy", "odd", "edges")}
    right = cover.withColumnsRenamed(names)
    # places out of a generator: conditions on them would be pushed below and work out the places again, each for itself
    at = points.select("*", F.explode(F.array(F.struct(x.alias("x"), y.alias("y")))).alias("__at"))
    left = at.select(*points.columns, F.col("__at.x").alias("__px"), F.col("__at.y").alias("__py")).filter("__px IS NOT NULL AND __py IS NOT NULL").withColumn(
        "__plv", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    cell = {f"__p{c}": F.floor((F.col(f"__p{v}") - SHIFT) / F.pow(F.lit(2.0), F.col("__plv"))) for c, v in (("cx", "x"), ("cy", "y"))}
    met = left.withColumns(cell).join(right, F.expr(" AND ".join(
        ["__plv = __lv", "__pcx = __cx", "__pcy = __cy", *[f"`{a}` = `{b}`" for a, b in on or []]])))
    hit = met.filter(F.col("__edges").isNull() | _in_partial(F.col("__px"), F.col("__py"), boundary))
    return hit.drop("__px", "__py", "__plv", "__pcx", "__pcy", *names.values())


def cover_polygons(polygons: DataFrame, poly: str, least_splits: int = LEAST_SPLITS) -> DataFrame:
    """Cover of every polygon with the polygon's other columns, stored."""
    key = "__pid"
    rows = cut_lineage(polygons.withColumn(key, F.monotonically_increasing_id()))
    cells = cover_edges(polygon_edges(rows, poly, key), key, least_splits)
    return cut_lineage(cells.join(rows.drop(poly), key).drop(key))
