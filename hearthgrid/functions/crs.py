"""Coordinate transformation between EPSG 4326, 25832/25833 and 3035 as Column math.

Transverse Mercator uses the Krueger series to the sixth order of the third flattening,
Lambert azimuthal equal area the ellipsoidal formulas of Snyder (1987). Both run on GRS80.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .geometry import col, let, make_point

# Fixed values of the GRS80 ellipsoid and the projections (EPSG registry).
A = 6378137.0
FLATTENING = 1 / 298.257222101
UTM_CENTRAL_MERIDIAN = {25831: 3.0, 25832: 9.0, 25833: 15.0}
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
LAEA = {"lat0": 52.0, "lon0": 10.0, "fe": 4321000.0, "fn": 3210000.0}

E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)

# Fixed coefficients of the Krueger series (forward and inverse), in powers of n.
_FORWARD = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_INVERSE = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
# Fixed coefficients conformal -> geodetic latitude.
_CONFORMAL = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def _asinh(x: Column) -> Column:
    return F.signum(x) * F.log(F.abs(x) + F.sqrt(x * x + 1))


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def _utm_from_lonlat(p: Column, lon0: float) -> Column:
    lat, lon = F.radians(p["y"]), F.radians(p["x"] - lon0)
    k = 2 * math.sqrt(_N) / (1 + _N)
    t = let(F.sin(lat), lambda s: F.sinh(_atanh(s) - k * _atanh(k * s)))

    def plane(t):
        xi, eta = F.atan2(t, F.cos(lon)), _atanh(F.sin(lon) / F.sqrt(1 + t * t))

        def series(v):
            xi0, eta0 = v["xi"], v["eta"]
            e, n = eta0, xi0
            for j, a in enumerate(_FORWARD, 1):
                e = e + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
                n = n + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            return make_point(UTM_FALSE_EASTING + UTM_SCALE * _RECTIFYING * e, UTM_SCALE * _RECTIFYING * n)

        return let(F.struct(xi.alias("xi"), eta.alias("eta")), series)

    return let(t, plane)


def _lonlat_from_utm(p: Column, lon0: float) -> Column:
    xi = p["y"] / (UTM_SCALE * _RECTIFYING)
    eta = (p["x"] - UTM_FALSE_EASTING) / (UTM_SCALE * _RECTIFYING)

    def series(v):
        x0, e0 = v["xi"], v["eta"]
        x, e = x0, e0
        for j, b in enumerate(_INVERSE, 1):
            x = x - b * F.sin(2 * j * x0) * F.cosh(2 * j * e0)
            e = e - b * F.cos(2 * j * x0) * F.sinh(2 * j * e0)

        def geodetic(w):
            chi = w["chi"]
            lat = chi
            for j, d in enumerate(_CONFORMAL, 1):
                lat = lat + d * F.sin(2 * j * chi)
            return make_point(F.degrees(w["lon"]) + lon0, F.degrees(lat))

        return let(F.struct(x.alias("x"), e.alias("e")), lambda q: let(F.struct(
            F.asin(F.sin(q["x"]) / F.cosh(q["e"])).alias("chi"),
            F.atan2(F.sinh(q["e"]), F.cos(q["x"])).alias("lon")), geodetic))

    return let(F.struct(xi.alias("xi"), eta.alias("eta")), series)


def _authalic_q(s: Column) -> Column:
    return (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def _q_of(lat: float) -> float:
    s = math.sin(lat)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


_QP = _q_of(math.pi / 2)
_LAT0 = math.radians(LAEA["lat0"])
_BETA0 = math.asin(_q_of(_LAT0) / _QP)
_RQ = A * math.sqrt(_QP / 2)
_D = A * (math.cos(_LAT0) / math.sqrt(1 - E2 * math.sin(_LAT0) ** 2)) / (_RQ * math.cos(_BETA0))


def _laea_from_lonlat(p: Column) -> Column:
    dlon = F.radians(p["x"] - LAEA["lon0"])
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _authalic_q(F.sin(F.radians(p["y"]))) / _QP)))
    sb0, cb0 = math.sin(_BETA0), math.cos(_BETA0)

    def plane(b):
        den = 1 + sb0 * F.sin(b) + cb0 * F.cos(b) * F.cos(dlon)
        scale = _RQ * F.sqrt(2 / den)
        return make_point(
            LAEA["fe"] + scale * _D * F.cos(b) * F.sin(dlon),
            LAEA["fn"] + scale / _D * (cb0 * F.sin(b) - sb0 * F.cos(b) * F.cos(dlon)))

    return let(beta, plane)


def _lonlat_from_laea(p: Column) -> Column:
    x, y = (p["x"] - LAEA["fe"]) / _D, (p["y"] - LAEA["fn"]) * _D
    sb0, cb0 = math.sin(_BETA0), math.cos(_BETA0)

    def sphere(v):
        rho = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        safe = F.when(rho == 0, F.lit(1.0)).otherwise(rho)
        c = 2 * F.asin(rho / (2 * _RQ))
        beta = F.asin(F.cos(c) * sb0 + v["y"] * F.sin(c) * cb0 / safe)
        lon = F.atan2(v["x"] * F.sin(c), safe * cb0 * F.cos(c) - v["y"] * sb0 * F.sin(c))
        return let(F.struct(beta.alias("b"), lon.alias("l")), lambda w: make_point(
            F.degrees(F.when(rho == 0, F.lit(0.0)).otherwise(w["l"])) + LAEA["lon0"],
            F.degrees(F.when(rho == 0, F.lit(_LAT0)).otherwise(
                w["b"] + (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040) * F.sin(2 * w["b"])
                + (23 * E2**2 / 360 + 251 * E2**3 / 3780) * F.sin(4 * w["b"])
                + (761 * E2**3 / 45360) * F.sin(6 * w["b"])))))

    return let(F.struct(x.alias("x"), y.alias("y")), sphere)


def transform_point(p, source: int, target: int) -> Column:
    p = col(p)
    if source == target:
        return p

    def to_lonlat(q):
        if source == 4326:
            return q
        if source == 3035:
            return _lonlat_from_laea(q)
        return _lonlat_from_utm(q, UTM_CENTRAL_MERIDIAN[source])

    def from_lonlat(q):
        if target == 4326:
            return q
        if target == 3035:
            return _laea_from_lonlat(q)
        return _utm_from_lonlat(q, UTM_CENTRAL_MERIDIAN[target])

    return F.when(p.isNotNull(), let(to_lonlat(p), from_lonlat))


def transform_line(line, source: int, target: int) -> Column:
    if source == target:
        return col(line)
    return F.transform(col(line), lambda p: transform_point(p, source, target))


def transform_polygon(poly, source: int, target: int) -> Column:
    return F.transform(col(poly), lambda r: transform_line(r, source, target))


def transform_multi(multi, source: int, target: int) -> Column:
    return F.transform(col(multi), lambda p: transform_polygon(p, source, target))


def normalize_srid(line, srid, known: list[int], target: int) -> tuple[Column, Column]:
    """Rows already in ``target`` pass, rows without a system get it, others are transformed."""
    line, srid = col(line), col(srid)
    out = F.when((srid == target) | (srid == 0), line)
    for source in known:
        if source != target:
            out = out.when(srid == source, transform_line(line, source, target))
    return out.otherwise(F.raise_error(F.format_string("unsupported SRID %d", srid.cast("int"))).cast(
        "array<struct<x:double,y:double>>")), F.lit(target)
