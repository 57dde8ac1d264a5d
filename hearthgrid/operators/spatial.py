"""Distributed spatial joins and nearest neighbours on plain DataFrames.

Both operators find candidates through equi-joins on integer cell keys, so Spark can shuffle,
split and (with AQE) re-balance them like any other join.

* ``spatial_join`` files every object at the grid level that fits its own size. An object then
  touches at most four cells of its level, however large it is, and a crowded place does not fill
  a cell with strangers: two objects meet only in a cell about as large as the larger of the two.
* ``knn_join`` walks down a pyramid of cells with bounds (branch and bound). A row keeps only the
  cells that may still hold one of its neighbours, so a crowded cell is never paired with
  everything around it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..session import cut_lineage, never_sent
from . import cover

# The level range keeps cell edges between about 1/1000 and 16 million map units.
MIN_LEVEL, MAX_LEVEL = -10, 24
BOX = ("xmin", "ymin", "xmax", "ymax")


def with_point_box(df: DataFrame, point: str | Column) -> DataFrame:
    p = G.col(point)
    return df.withColumns({"xmin": p["x"], "ymin": p["y"], "xmax": p["x"], "ymax": p["y"]})


def with_box(df: DataFrame, box: Column) -> DataFrame:
    b = "__box"
    return df.withColumn(b, box).withColumns({k: F.col(f"{b}.{k}") for k in BOX}).drop(b)


def with_line_box(df: DataFrame, line: str) -> DataFrame:
    return with_box(df, G.bbox_points(line))


def with_polygon_box(df: DataFrame, poly: str) -> DataFrame:
    return with_box(df, G.bbox_polygon(poly))


def _num(v: float) -> str:
    return f"{float(v)!r}D"


def _level(eps: float) -> str:
    """Smallest level whose cell is at least as large as the object grown by eps, as SQL."""
    size = f"greatest(xmax - xmin, ymax - ymin) + {_num(2 * eps)}"
    return f"cast(least({MAX_LEVEL}, ceil(log2(greatest({size}, {_num(2.0**MIN_LEVEL)})))) as int)"


def point_level(eps: float) -> int:
    return min(MAX_LEVEL, math.ceil(math.log2(max(2 * eps, 2.0**MIN_LEVEL))))


def _levels_present(df: DataFrame, eps: float) -> list[int]:
    """One small aggregate: at most MAX_LEVEL - MIN_LEVEL + 1 integers reach the driver."""
    return sorted(df.selectExpr(f"{_level(eps)} AS l").agg(F.collect_set("l").alias("ls")).first()["ls"])


def _levels_and_span(df: DataFrame, eps: float) -> tuple[list[int], list[float]]:
    """The levels, and the box around all boxes, from one small aggregate."""
    row = df.selectExpr(*BOX, f"{_level(eps)} AS l").agg(
        F.collect_set("l").alias("ls"), F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    return sorted(row["ls"]), list(row)[1:]


def _inside_span(span: list[float], eps: float) -> str:
    """Condition of rows that can come within ``eps`` of a box of a table that ends at ``span``, as SQL."""
    if None in span:
        return "true"
    x0, y0, x1, y1 = map(_num, span)
    e = _num(eps)
    return f"xmin - {e} <= {x1} AND xmax + {e} >= {x0} AND ymin - {e} <= {y1} AND ymax + {e} >= {y0}"


def _boxes_once(df: DataFrame, inside: str) -> DataFrame:
    """Rows ``inside``, their boxes out of a generator.

    Filters on a box (the join infers some, too) would be pushed below it and work out the shapes again for each bound.
    """
    kept = [f"__at.{c} AS {c}" if c in BOX else f"`{c}`" for c in df.columns]
    return df.selectExpr("*", f"explode(CASE WHEN {inside} THEN array(struct({', '.join(BOX)})) END) AS __at").selectExpr(*kept)


def _entries(df: DataFrame, eps: float, others: list[int], prefix: str) -> DataFrame:
    """One row per (object, level, cell it touches there).

    A pair meets at the level of its larger object: an object is needed at its own level, when the
    other side has anything as small, and at the levels of larger objects of the other side.
    """
    own, e = f"{prefix}own", _num(eps)
    lv = f"filter(array_union(array({own}), array({', '.join(map(str, others))})), v -> v >= {own} AND v >= {min(others)})"

    def cells(lo: str, hi: str) -> str:
        return f"explode(sequence(floor(({lo} - {e}) / pow(2D, __lv)), floor(({hi} + {e}) / pow(2D, __lv))))"

    return df.selectExpr("*", f"{_level(eps)} AS {own}").selectExpr("*", f"explode({lv}) AS __lv").selectExpr(
        "*", f"{cells('xmin', 'xmax')} AS __cx").selectExpr("*", f"{cells('ymin', 'ymax')} AS __cy")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    predicate: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    eps: float = 0.0,
    left_levels: list[int] | None = None,
    right_levels: list[int] | None = None,
    how: str = "inner",
    on: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Pairs whose boxes come within ``eps`` and that satisfy ``predicate``.

    Both sides carry xmin, ymin, xmax, ymax; other column names must differ. ``predicate`` gets two
    functions that return the columns of the left and of the right side. Levels are known for
    points (``[point_level(eps)]``); otherwise one small job reads them from the boxes. ``on`` adds
    pairs of columns that must be equal to the join key.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("how must be inner or left_semi")
    # a table that reaches further than the other is not filed where the other has nothing; the span comes with the levels
    lefts = rights = "true"
    if not left_levels:
        left_levels, span = _levels_and_span(left, eps)
        rights = _inside_span(span, eps)
    if not right_levels:
        right_levels, span = _levels_and_span(right, 0.0)
        lefts = _inside_span(span, eps)
    # an empty side has no level; any one serves
    if not left_levels or not right_levels:
        left_levels = right_levels = [MIN_LEVEL]
    key = ["__lv", "__cx", "__cy"]
    l = _entries(_boxes_once(left, lefts), eps, right_levels, "__l_")
    r = _entries(_boxes_once(right, rights), 0.0, left_levels, "__r_").withColumnsRenamed({c: f"__r_{c}" for c in (*BOX, *key)})
    e = _num(eps)
    cond = " AND ".join([
        "__lv = __r___lv", "__cx = __r___cx", "__cy = __r___cy", *[f"`{a}` = `{b}`" for a, b in on or []],
        # the pair belongs to the level of the larger object
        "greatest(__l_own, __r_own) = __lv",
        f"xmin - {e} <= __r_xmax", f"__r_xmin <= xmax + {e}", f"ymin - {e} <= __r_ymax", f"__r_ymin <= ymax + {e}",
        # and to the one cell that holds the lower left corner of the common box
        f"__cx = floor(greatest(xmin - {e}, __r_xmin) / pow(2D, __lv))",
        f"__cy = floor(greatest(ymin - {e}, __r_ymin) / pow(2D, __lv))"])
    met = F.expr(cond)
    if predicate is not None:
        # behind the comparisons of boxes: as a filter Spark would put it before them
        right_box = set(BOX)
        met = met & predicate(lambda c: F.col(c), lambda c: F.col(f"__r_{c}") if c in right_box else F.col(c))
    out = l.join(r, met, "inner").drop(*key, "__l_own", "__r_own", *[f"__r_{c}" for c in (*BOX, *key)])
    if how == "left_semi":
        out = out.select(*left.columns).distinct()
    return out


def half_pairs(df: DataFrame, key: str, cols: list[str], predicate, eps: float,
               levels: list[int] | None = None, same: list[str] | None = None) -> DataFrame:
    """Unordered pairs a < b within ``eps`` with equal ``same`` columns; prefixes a_ and b_."""
    keep = [key, *cols]
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in keep], *BOX)
    b = never_sent(df.select(*[F.col(c).alias(f"b_{c}") for c in keep], *BOX))
    return spatial_join(
        a, b, lambda l, r: (l(f"a_{key}") < r(f"b_{key}")) & predicate(
            lambda c: l(f"a_{c}"), lambda c: r(f"b_{c}")),
        eps, levels, levels, on=[(f"a_{c}", f"b_{c}") for c in same or []]).drop(*BOX)


def both_directions(pairs: DataFrame) -> DataFrame:
    """Pairs a < b plus their mirror image."""
    names = [c[2:] for c in pairs.columns if c.startswith("a_")]
    mirrored = pairs.select(
        *[F.col(f"b_{n}").alias(f"a_{n}") for n in names], *[F.col(f"a_{n}").alias(f"b_{n}") for n in names])
    return pairs.select(*[f"a_{n}" for n in names], *[f"b_{n}" for n in names]).unionByName(mirrored)


def within_distance_points(df: DataFrame, key: str, eps: float, cols: list[str] | None = None) -> DataFrame:
    """Half pairs of points (columns x, y) at most ``eps`` apart."""
    boxed = df.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})

    def near(a, b):
        dx, dy = a("x") - b("x"), a("y") - b("y")
        return dx * dx + dy * dy <= eps * eps

    extra = [c for c in (cols or []) if c not in ("x", "y")]
    # left boxes grow by eps, right ones do not: both levels are fixed for points
    a = boxed.select(*[F.col(c).alias(f"a_{c}") for c in [key, "x", "y", *extra]], *BOX)
    b = boxed.select(*[F.col(c).alias(f"b_{c}") for c in [key, "x", "y", *extra]], *BOX)
    return spatial_join(
        a, b, lambda l, r: (l(f"a_{key}") < r(f"b_{key}")) & near(
            lambda c: l(f"a_{c}"), lambda c: r(f"b_{c}")),
        eps, [point_level(eps)], [point_level(0.0)]).drop(*BOX)


#: most heads of a crowded cell: its points are tied to one of them, and these to the head of the cell; places per head of a full set
_SALTS, _SALT_PLACES = 64, 100_000


def cluster_places(places: DataFrame, eps: float) -> DataFrame:
    """key, component of distinct places (a stored table of key: numbers, x, y) linked by steps of at most ``eps``; lone places have no row.

    Places of one cell of half the distance belong together, so they are tied to one place of the cell
    instead of to each other; only places of different cells are compared. Ties go over the heads of
    parts of a cell, so a crowded cell is no single group.
    """
    from . import graph

    salts = max(1, min(_SALTS, places.count() // _SALT_PLACES))  # few places need no parts; the clusters are the same
    filed = places.select("key", "x", "y", F.floor(F.col("x") / (eps / 2)).alias("cx"), F.floor(F.col("y") / (eps / 2)).alias("cy"),
                          F.pmod(F.xxhash64("key"), F.lit(salts)).alias("part"))
    parts = filed.groupBy("cx", "cy", "part").agg(F.min("key").alias("head"), F.count("*").alias("n"))
    heads = parts.join(parts.groupBy("cx", "cy").agg(F.min("head").alias("first"), F.sum("n").alias("all")), ["cx", "cy"]).filter("all > 1")
    inside = filed.join(heads.select("cx", "cy", "part", "head"), ["cx", "cy", "part"]).select(F.col("key").alias("source"), F.col("head").alias("target")).unionByName(
        heads.select(F.col("head").alias("source"), F.col("first").alias("target"))).filter("source <> target")
    near = within_distance_points(filed, "key", eps, ["cx", "cy"]).filter(
        "a_cx <> b_cx or a_cy <> b_cy").select(F.col("a_key").alias("source"), F.col("b_key").alias("target"))
    return graph.connected_components(inside.unionByName(near)).withColumnRenamed("node", "key")


def cluster_within(points: DataFrame, eps: float) -> DataFrame:
    """Clusters of points (x, y) linked by steps of at most ``eps``: x, y, component (its least point). Equal points collapse first."""
    places = cut_lineage(points.select("x", "y").distinct().withColumn("key", F.monotonically_increasing_id()))
    placed = places.join(cluster_places(places, eps), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = placed.groupBy("component").agg(F.min(F.struct("x", "y")).alias("least"))
    return placed.join(least, "component").select("x", "y", F.col("least").alias("component"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, point: str, poly: str,
                       how: str = "inner", boundary: bool = False) -> DataFrame:
    """Rows of ``points`` with the other columns of the polygons that contain them.

    Points on an edge are outside, unless ``boundary``. The polygons are filed by the cells that
    cover them; points of full cells need no test, others meet the edges of their cell.
    """
    out = cover.points_in_cover(points, cover.cover_polygons(polygons, poly), G.col(point)["x"], G.col(point)["y"], boundary)
    return out.select(*points.columns).distinct() if how == "left_semi" else out


def cell_key(x, y, size: float) -> tuple[Column, Column]:
    """Index of the regular cell that holds a point; replaces a point-in-square test."""
    return F.floor(G.col(x) / size), F.floor(G.col(y) / size)


# ---------------------------------------------------------------- nearest neighbours

_BITS = 2          # a step down splits a cell into 4 x 4
_TOP_STEPS = 3     # 4 ** (2 * 3) = 4096 cells at most: a proven bound for a broadcast


_MAX_STEPS = 13
_LEAF_ROWS = 64


def _depth(right: DataFrame, by: list[str], n: int, x0: float, y0: float, extent: float) -> int:
    """Splits until the fullest cell is small; uniform data needs log n, a crowded place more.

    The depth only decides speed. Cells are counted once at the finest grid and rolled up; one row
    with a number per depth reaches the driver.
    """
    first = max(1, math.ceil(math.log(n, 4 ** _BITS)))
    if n <= _LEAF_ROWS or first >= _MAX_STEPS:
        return min(first, _MAX_STEPS)
    side = 1 << (_BITS * _MAX_STEPS)

    def index(lo: str, hi: str, origin: float) -> str:
        return f"cast(floor((({lo} + {hi}) / 2 - {_num(origin)}) / {_num(extent)} * {side}) AS BIGINT)"

    finest = right.selectExpr(*by, f"{index('xmin', 'xmax', x0)} AS cx", f"{index('ymin', 'ymax', y0)} AS cy").groupBy(
        *by, "cx", "cy").agg(F.count("*").alias("n"))
    depths = ", ".join(str(d) for d in range(first, _MAX_STEPS + 1))
    fullest = finest.selectExpr(*by, "cx", "cy", "n", f"explode(array({depths})) AS d").selectExpr(
        *by, "d", f"shiftright(cx, {_BITS} * ({_MAX_STEPS} - d)) AS cx", f"shiftright(cy, {_BITS} * ({_MAX_STEPS} - d)) AS cy", "n"
    ).groupBy(*by, "d", "cx", "cy").agg(F.sum("n").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
    counts = {r["d"]: r["n"] for r in fullest}
    best = min(counts.values())
    return min(d for d, c in counts.items() if c <= max(_LEAF_ROWS, 2 * best))


def _mindist2(p: str, b: str) -> str:
    return " + ".join(
        f"pow(greatest({b}.{a}min - {p}.{a}max, {p}.{a}min - {b}.{a}max, 0D), 2)" for a in "xy")


def _maxdist2(p: str, b: str) -> str:
    return " + ".join(f"pow(greatest({b}.{a}max - {p}.{a}min, {p}.{a}max - {b}.{a}min), 2)" for a in "xy")


def _facedist2(p: str, b: str) -> str:
    """Bound for the nearest point of a tight box: each of its four sides holds one of its points."""
    far = {a: f"pow(greatest({b}.{a}max - {p}.{a}min, {p}.{a}max - {b}.{a}min), 2)" for a in "xy"}
    side = [f"pow(greatest(abs({b}.{a}{m} - {p}.{a}min), abs({b}.{a}{m} - {p}.{a}max)), 2) + {far['y' if a == 'x' else 'x']}" for a in "xy" for m in ("min", "max")]
    return f"least({', '.join(side)})"


def knn_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str | list[str],
    right_key: str,
    distance: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    k: int = 1,
    radius: float | None = None,
    by: list[str] | None = None,
    left_cols: list[str] | None = None,
) -> DataFrame:
    """The ``k`` nearest right rows of every left row: left key, ``dist`` (and ``rank``), right columns.

    The left key is unique. Left rows are points (x, y) or, with ``left_cols``, objects with a
    column ``lbox`` (xmin .. ymax) and the columns that the distance needs. Right rows carry a box.
    ``distance`` is the exact distance; it must lie between the smallest and the largest distance of
    the two boxes. Neighbours share the values of ``by``. Ties go to the smaller ``right_key``. Left
    rows beyond ``radius`` of everything are not returned.
    """
    lkeys = [left_key] if isinstance(left_key, str) else list(left_key)
    by = list(by or [])
    carried = list(dict.fromkeys(lkeys + by + list(left_cols or ["x", "y"])))
    # of right points in one place only the k smallest keys can win; the limit also works map-side
    place = ", ".join([*by, *BOX, f"CASE WHEN xmin = xmax AND ymin = ymax THEN NULL ELSE {right_key} END"])
    kept = right.filter("xmin is not null and ymin is not null").selectExpr(
        "*", f"row_number() OVER (PARTITION BY {place} ORDER BY {right_key}) AS __dup").filter(f"__dup <= {k}").drop("__dup")
    payload = [c for c in right.columns if c not in BOX and c not in lkeys and c not in by]
    right = cut_lineage(kept)
    stats = right.agg(
        F.count("*").alias("n"), F.min("xmin").alias("x0"), F.min("ymin").alias("y0"),
        F.max("xmax").alias("x1"), F.max("ymax").alias("y1"), F.expr("every(xmin <=> xmax AND ymin <=> ymax)").alias("points")).first()
    n = max(stats["n"], 1)
    x0, y0 = stats["x0"] or 0.0, stats["y0"] or 0.0
    extent = max((stats["x1"] or 0.0) - x0, (stats["y1"] or 0.0) - y0, 1e-9) * (1 + 1e-9)
    steps = _depth(right, by, n, x0, y0, extent)
    side = 1 << (_BITS * steps)

    def index(lo: str, hi: str, origin: float) -> str:
        return f"least(floor((({lo} + {hi}) / 2 - {_num(origin)}) / {_num(extent)} * {side}), {side - 1})"

    leaf = right.selectExpr("*", f"{index('xmin', 'xmax', x0)} AS __cx", f"{index('ymin', 'ymax', y0)} AS __cy")
    merged = [F.expr(e) for e in (
        "sum(n) AS n", "min(xmin) AS xmin", "min(ymin) AS ymin", "max(xmax) AS xmax", "max(ymax) AS ymax")]
    bounds = leaf.select(*by, "__cx", "__cy", F.lit(1).alias("n"), *BOX).groupBy(*by, "__cx", "__cy").agg(*merged)

    def nodes_at(step: int) -> DataFrame:
        """Cells after ``step`` splits with their members' box, keyed by their parent cell."""
        shift = _BITS * (steps - step)
        up = bounds
        if shift:
            up = bounds.selectExpr(
                *by, f"shiftright(__cx, {shift}) AS __cx", f"shiftright(__cy, {shift}) AS __cy", "n", *BOX
            ).groupBy(*by, "__cx", "__cy").agg(*merged)
        return up.selectExpr(
            *by, f"shiftright(__cx, {_BITS}) AS __cx", f"shiftright(__cy, {_BITS}) AS __cy", "__cx AS __nx", "__cy AS __ny",
            "struct(n, xmin, ymin, xmax, ymax) AS __node")

    box = "struct(x AS xmin, y AS ymin, x AS xmax, y AS ymax)" if left_cols is None else "lbox"
    frontier = left.withColumn("__p", F.expr(box)).filter("__p.xmin is not null and __p.ymin is not null").selectExpr(
        *carried, "__p", "0L AS __cx", "0L AS __cy", "double('infinity') AS __bound")
    own = ", ".join(lkeys)
    # the slack keeps ties that rounding in the squared sums could push over the bound
    slack = "(1 + 1e-9D)"
    for step in range(1, steps + 1):
        nodes = nodes_at(step)
        if step <= _TOP_STEPS and not by:
            nodes = F.broadcast(nodes)
        # of points, the sides of a tight box tell more than its far corner: a row far off keeps a thin strip
        near = _facedist2("__p", "__node") if stats["points"] else _maxdist2("__p", "__node")
        # the bound of the step before drops cells before they are shuffled
        keep = f"__lo <= __bound * {slack}"
        if radius is not None:
            keep += f" AND __lo <= {_num(radius ** 2)} * {slack}"
        frontier = frontier.join(nodes, [*by, "__cx", "__cy"]).selectExpr(
            *carried, "__p", "__bound", "__nx", "__ny", "__node", f"{_mindist2('__p', '__node')} AS __lo").filter(keep).selectExpr(
            *carried, "__p", "__bound", "__nx", "__ny", "__lo", f"{near} AS __near", *([f"{_maxdist2('__p', '__node')} AS __hi", "__node.n AS __n"] if k > 1 else []))
        reach = "__near"
        if k > 1:
            # k rows lie within the k-th of the cells by their first rows, and within the cells that hold k rows in all
            frontier = frontier.selectExpr("*", f"sum(__n) OVER (PARTITION BY {own} ORDER BY __hi, __nx, __ny) AS __seen",
                                           f"row_number() OVER (PARTITION BY {own} ORDER BY __near, __nx, __ny) AS __first")
            reach = f"least(CASE WHEN __seen >= {k} THEN __hi END, CASE WHEN __first >= {k} THEN __near END)"
        frontier = frontier.selectExpr(*carried, "__p", "__nx AS __cx", "__ny AS __cy", "__lo", f"least(__bound, min({reach}) OVER (PARTITION BY {own})) AS __bound").filter(
            f"__lo <= __bound * {slack}").drop("__lo")

    within = _mindist2("__p", "__box")
    pairs = frontier.join(leaf.withColumn("__box", F.struct(*BOX)), [*by, "__cx", "__cy"]).filter(f"{within} <= __bound * {slack}").withColumn(
        "dist", distance(F.col, F.col))
    if radius is not None:
        pairs = pairs.filter(F.col("dist") <= float(radius))
    shown = [c for c in by if c not in lkeys]
    if k == 1:
        best = pairs.groupBy(*lkeys).agg(
            F.min_by(F.struct("dist", *shown, *payload), F.struct("dist", right_key)).alias("__best"))
        return best.select(*lkeys, "__best.*")
    rank = F.row_number().over(Window.partitionBy(*lkeys).orderBy("dist", right_key))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(*lkeys, "dist", "rank", *shown, *payload)


def point_to_box(l, r) -> Column:
    """Distance from (x, y) to the box of the right row: exact for points and upright rectangles."""
    dx = F.greatest(r("xmin") - l("x"), l("x") - r("xmax"), F.lit(0.0))
    dy = F.greatest(r("ymin") - l("y"), l("y") - r("ymax"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def nearest_within(points: DataFrame, lines: DataFrame, key: str, line_key: str, line: str, radius: float,
                   beyond: float | None = None, rings: tuple[float, ...] = (1 / 8, 1.0),
                   on: str | list[str] | None = None, exclude: tuple[str, str] | None = None) -> DataFrame:
    """Nearest line of each point (columns x, y) at ``beyond`` < distance <= ``radius``.

    The search grows in rings; a point settled in a ring is complete there, because every line
    within that distance was a candidate. Only the others go on to the next ring. ``on`` are columns
    both sides share; ``exclude`` names a point column that must differ from a line column.
    """
    on = [on] if isinstance(on, str) else list(on or [])
    right = with_line_box(lines.select(line_key, line, *[F.col(c).alias(f"__on_{c}") for c in on]), line)
    levels, span = _levels_and_span(right, 0.0)
    carried = list(dict.fromkeys([key, "x", "y", *on, *([exclude[0]] if exclude else [])]))
    todo = points.select(*carried).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = todo.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    right = _boxes_once(right, _inside_span(list(ends), radius))
    done = None
    for part in rings:
        r = radius * part
        left = todo.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")}).filter(_inside_span(span, r))
        # out of a generator: each condition on the distance would work it out again
        found = spatial_join(left, right, None, r, [point_level(r)], levels, on=[(c, f"__on_{c}") for c in on]).withColumn(
            "dist", F.explode(F.array(G.distance_point_line(G.make_point("x", "y"), line)))).filter(F.col("dist") <= r)
        if beyond is not None:
            found = found.filter(F.col("dist") > beyond)
        if exclude is not None:
            found = found.filter(~F.col(exclude[0]).eqNullSafe(F.col(exclude[1])))
        # each ring is used twice: in the result and to find what is left for the next one
        best = cut_lineage(found.groupBy(key).agg(F.min_by(
            F.struct("dist", line_key), F.struct("dist", line_key)).alias("__b")))
        # unpacked after the checkpoint: a bare checkpoint under a union and a join trips the optimizer
        best = best.select(key, F.abs("__b.dist").alias("dist"), F.col("__b")[line_key].alias(line_key))
        done = best if done is None else done.unionByName(best)
        todo = todo.join(best.select(key), key, "left_anti")
    return done


# ---------------------------------------------------------------- grids


def _ticks(lo, hi, size: float) -> Column:
    first, last = F.floor(lo / size), F.ceil(hi / size)
    return F.filter(F.sequence(first, F.greatest(first, last)), lambda i: i < last)


def square_grid(areas: DataFrame, size: float) -> DataFrame:
    """All cells of the snapped box of each area: gx, gy are the lower left corners.

    Columns of cells are spread over the cluster before they are filled, so that one large area is
    not unfolded in one task.
    """
    stripes = areas.withColumn("__ix", F.explode(_ticks(F.col("xmin"), F.col("xmax"), size))).repartition("__ix")
    return stripes.withColumn("__iy", F.explode(_ticks(F.col("ymin"), F.col("ymax"), size))).withColumns(
        {"gx": F.col("__ix") * F.lit(float(size)), "gy": F.col("__iy") * F.lit(float(size))}).drop("__ix", "__iy")


def covered_grid(areas: DataFrame, poly: str, size: float) -> DataFrame:
    """Cells whose centre an area covers.

    The edges are cut once per column of cells; a cell then only counts the cuts below its centre.
    """
    stripes = with_polygon_box(areas, poly).withColumn(
        "__ix", F.explode(_ticks(F.col("xmin"), F.col("xmax"), size))).repartition("__ix")
    xc = (F.col("__ix") + 0.5) * float(size)
    cuts = F.transform(
        F.filter(G.polygon_segments(poly), lambda s: (s["ax"] > xc) != (s["bx"] > xc)),
        lambda s: s["ay"] + (xc - s["ax"]) * (s["by"] - s["ay"])
        / F.when(s["bx"] == s["ax"], F.lit(1.0)).otherwise(s["bx"] - s["ax"]))
    cells = stripes.withColumn("__cuts", cuts).withColumn(
        "__iy", F.explode(_ticks(F.col("ymin"), F.col("ymax"), size)))
    yc = (F.col("__iy") + 0.5) * float(size)
    inside = F.size(F.filter("__cuts", lambda c: c < yc)) % 2 == 1
    return cells.filter(inside | F.array_contains("__cuts", yc)).withColumns(
        {"gx": F.col("__ix") * F.lit(float(size)), "gy": F.col("__iy") * F.lit(float(size))}).drop(
        "__ix", "__iy", "__cuts", *BOX)


def cover_cells(areas: DataFrame, poly: str, size: float) -> DataFrame:
    """Cells that meet a polygon, with ``full`` where the whole cell lies inside."""
    cells = square_grid(with_polygon_box(areas, poly), size).withColumn(
        "cell", G.make_box("gx", "gy", F.col("gx") + size, F.col("gy") + size))
    border = F.exists(G.polygon_segments(poly), lambda s: F.exists(
        G.polygon_segments("cell"), lambda c: G.segments_meet(s, c)))
    inside = G.inside_even_odd(poly, G.make_point(F.col("gx") + size / 2, F.col("gy") + size / 2))
    return cells.withColumn("__border", border).filter(F.col("__border") | inside).withColumn(
        "full", ~F.col("__border")).drop("__border", *BOX)


def tile_cover(areas: DataFrame, poly: str, size: int, offset_x: int = 0, offset_y: int = 0) -> DataFrame:
    """Origins of the tiles (shifted grid) that meet an area, with their kilometre index."""
    boxed = with_polygon_box(areas, poly)

    def ticks(lo, hi, off):
        return F.sequence(F.floor((F.col(lo) - off) / size), F.floor((F.col(hi) - off) / size))

    tiles = boxed.withColumn("__ix", F.explode(ticks("xmin", "xmax", offset_x))).withColumn(
        "__iy", F.explode(ticks("ymin", "ymax", offset_y))).withColumns({
            "tile_x": F.col("__ix") * size + offset_x, "tile_y": F.col("__iy") * size + offset_y})
    box = G.make_box("tile_x", "tile_y", F.col("tile_x") + size, F.col("tile_y") + size)
    return tiles.filter(G.intersects_polygons(poly, box)).withColumns({
        "e_km": F.floor(F.col("tile_x") / 1000), "n_km": F.floor(F.col("tile_y") / 1000)}).drop(
        "__ix", "__iy", *BOX)
