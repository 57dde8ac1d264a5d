"""WKT and WKB for the struct geometries, and line simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .geometry import LINE, MULTI, POLYGON, col, let, make_point
from ..session import ship_active

# ---------------------------------------------------------------- WKT


def _digits(v: Column) -> Column:
    """Plain decimal text without trailing zeros or exponent."""
    return F.regexp_replace(v.cast("decimal(28,10)").cast("string"), r"\.?0+$", "")


def _wkt_coords(line: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(
        F.transform(line, lambda p: F.concat(_digits(p["x"]), F.lit(" "), _digits(p["y"]))), ","), F.lit(")"))


def _wkt_rings(poly: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(poly, _wkt_coords), ","), F.lit(")"))


def to_wkt(g, kind: str) -> Column:
    g = col(g)
    if kind == "point":
        return F.concat(F.lit("POINT("), _digits(g["x"]), F.lit(" "), _digits(g["y"]), F.lit(")"))
    if kind == "line":
        return F.concat(F.lit("LINESTRING"), _wkt_coords(g))
    if kind == "polygon":
        return F.concat(F.lit("POLYGON"), _wkt_rings(g))
    if kind == "multi":
        return F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(g, _wkt_rings), ","), F.lit(")"))
    raise ValueError(f"unknown geometry kind {kind!r}")


def _parse_coords(txt: Column) -> Column:
    def one(pair):
        xy = F.split(F.trim(pair), r"\s+")
        return make_point(F.get(xy, 0).cast("double"), F.get(xy, 1).cast("double"))

    return F.transform(F.split(F.regexp_replace(txt, r"[()]", ""), ","), one)


def _parse_rings(txt: Column) -> Column:
    return F.transform(F.split(txt, r"\)\s*,\s*\("), _parse_coords)


def from_wkt(txt, kind: str) -> Column:
    body = F.regexp_replace(F.trim(col(txt)), r"^(?i)[a-z]+\s*z?\s*", "")
    if kind == "point":
        return let(_parse_coords(body), lambda c: F.get(c, 0))
    if kind == "line":
        return _parse_coords(body)
    if kind == "polygon":
        return _parse_rings(body)
    if kind == "multi":
        return F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), _parse_rings)
    raise ValueError(f"unknown geometry kind {kind!r}")


def spark_type(kind: str) -> str:
    return {"point": "struct<x:double,y:double>", "line": LINE, "polygon": POLYGON, "multi": MULTI}[kind]


def kind_of(simple_string: str) -> str | None:
    """Geometry kind of a Spark type, None for other types."""
    for kind in ("point", "line", "polygon", "multi"):
        if spark_type(kind) == simple_string:
            return kind
    return None


# ---------------------------------------------------------------- WKB
# Fixed type codes of the format.
WKB_CODES = {"point": 1, "line": 2, "polygon": 3, "multi": 6}


def _ring_bytes(xs: np.ndarray, ys: np.ndarray) -> bytes:
    return np.uint32(len(xs)).tobytes() + np.column_stack([xs, ys]).astype("<f8").tobytes()


def to_wkb(g, kind: str) -> Column:
    """Little endian WKB through one Arrow batch function on flat coordinate arrays."""
    g = col(g)
    code = WKB_CODES[kind]
    if kind == "point":
        multi = F.when(g.isNotNull(), F.array(F.array(F.array(g))))
    elif kind == "line":
        multi = F.when(g.isNotNull(), F.array(F.array(g)))
    elif kind == "polygon":
        multi = F.when(g.isNotNull(), F.array(g))
    else:
        multi = g

    ship_active()

    @F.pandas_udf("binary")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        head = b"\x01" + np.uint32(code).tobytes()
        part_head = b"\x01" + np.uint32(3).tobytes()
        for parts, rings, xs, ys in batches:
            out = []
            for n_rings, n_points, x, y in zip(parts, rings, xs, ys):
                if n_rings is None:
                    out.append(None)
                    continue
                x, y = np.asarray(x, dtype="<f8"), np.asarray(y, dtype="<f8")
                if kind == "point":
                    out.append(head + x.tobytes() + y.tobytes())
                    continue
                at = np.concatenate([[0], np.cumsum(n_points)]).astype(int)
                blobs = [_ring_bytes(x[a:b], y[a:b]) for a, b in zip(at[:-1], at[1:])]
                if kind == "line":
                    out.append(head + blobs[0])
                elif kind == "polygon":
                    out.append(head + np.uint32(len(blobs)).tobytes() + b"".join(blobs))
                else:
                    body, i = b"", 0
                    for n in n_rings:
                        body += part_head + np.uint32(n).tobytes() + b"".join(blobs[i:i + n])
                        i += n
                    out.append(head + np.uint32(len(n_rings)).tobytes() + body)
            yield pd.Series(out, dtype=object)

    rings = F.flatten(multi)
    points = F.flatten(rings)
    return encode(
        F.transform(multi, lambda p: F.size(p)), F.transform(rings, lambda r: F.size(r)),
        F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


def stable_geom_id(g, kind: str) -> Column:
    """md5 of the exact binary form: equal geometries share it, any other coordinate changes it."""
    return F.md5(to_wkb(g, kind))


def from_wkb(blob, kind: str) -> Column:
    """Inverse of :func:`to_wkb` (two dimensional, either byte order)."""
    flat = "parts array<int>, rings array<int>, xs array<double>, ys array<double>"

    ship_active()

    @F.pandas_udf(flat)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for blobs in batches:
            rows = [_scan_wkb(b) for b in blobs]
            yield pd.DataFrame(rows, columns=["parts", "rings", "xs", "ys"])

    def rebuild(v):
        offsets = F.aggregate(
            v["rings"], F.array(F.lit(0)),
            lambda acc, n: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + n)))
        points = F.zip_with(v["xs"], v["ys"], lambda x, y: make_point(x, y))
        all_rings = F.zip_with(
            F.slice(offsets, F.lit(1), F.size(v["rings"])), v["rings"],
            lambda at, n: F.slice(points, at + 1, n))
        if kind == "multi":
            starts = F.aggregate(
                v["parts"], F.array(F.lit(0)),
                lambda acc, n: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + n)))
            return let(all_rings, lambda rs: F.zip_with(
                F.slice(starts, F.lit(1), F.size(v["parts"])), v["parts"], lambda at, n: F.slice(rs, at + 1, n)))
        if kind == "polygon":
            return all_rings
        if kind == "line":
            return F.get(all_rings, 0)
        return F.get(F.get(all_rings, 0), 0)

    return F.when(col(blob).isNotNull(), let(decode(col(blob)), rebuild))


def _scan_wkb(blob: bytes | None):
    if blob is None:
        return None, None, None, None
    pos = 0

    def header():
        nonlocal pos
        order = "<" if blob[pos] == 1 else ">"
        code = int(np.frombuffer(blob, order + "u4", 1, pos + 1)[0])
        pos += 5
        return order, code & 0xFF

    def ring(order, n=None):
        nonlocal pos
        if n is None:
            n = int(np.frombuffer(blob, order + "u4", 1, pos)[0])
            pos += 4
        xy = np.frombuffer(blob, order + "f8", 2 * n, pos).reshape(n, 2)
        pos += 16 * n
        return xy

    def count(order):
        nonlocal pos
        n = int(np.frombuffer(blob, order + "u4", 1, pos)[0])
        pos += 4
        return n

    order, code = header()
    if code == 1:
        parts, rings = [1], [ring(order, 1)]
    elif code == 2:
        parts, rings = [1], [ring(order)]
    elif code == 3:
        n = count(order)
        parts, rings = [n], [ring(order) for _ in range(n)]
    elif code == 6:
        parts, rings = [], []
        for _ in range(count(order)):
            inner, _ = header()
            n = count(inner)
            parts.append(n)
            rings.extend(ring(inner) for _ in range(n))
    else:
        raise ValueError(f"unsupported WKB type {code}")
    xy = np.concatenate(rings)
    return parts, [len(r) for r in rings], xy[:, 0].tolist(), xy[:, 1].tolist()


# ---------------------------------------------------------------- simplification


def _kept(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """Indices kept by recursive halving at the farthest vertex; closed rings keep four."""
    n = len(x)
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    closed = n >= 4 and x[0] == x[-1] and y[0] == y[-1]
    todo = [(0, n - 1)]
    if closed:
        far = int(np.argmax((x - x[0]) ** 2 + (y - y[0]) ** 2))
        keep[far] = True
        todo = [(0, far), (far, n - 1)]
    spare: list[tuple[float, int]] = []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1:b], y[a + 1:b]
        dx, dy = x[b] - x[a], y[b] - y[a]
        norm = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / norm, 0, 1) if norm else np.zeros(b - a - 1)
        d = np.hypot(px - x[a] - t * dx, py - y[a] - t * dy)
        i = int(np.argmax(d))
        if d[i] > tol:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
        else:
            spare.append((float(d[i]), a + 1 + i))
    for _, i in sorted(spare, reverse=True):
        if not closed or keep.sum() >= 4:
            break
        keep[i] = True
    return np.flatnonzero(keep)


def simplify(line, tolerance: float) -> Column:
    """Douglas-Peucker on a line or ring; Arrow batches carry bare coordinate arrays."""
    line = col(line)

    ship_active()

    @F.pandas_udf("array<int>")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([
                None if x is None else _kept(np.asarray(x), np.asarray(y), tolerance).tolist()
                for x, y in zip(xs, ys)], dtype=object)

    idx = kept(F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"]))
    return let(F.struct(line.alias("g"), idx.alias("i")),
               lambda v: F.transform(v["i"], lambda i: F.get(v["g"], i)))
