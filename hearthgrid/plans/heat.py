"""Heat demand: envelope areas, refurbishment, thermal values, annual demand, density per street."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..operators import tables
from ..session import ship_package

WINDOW_SHARE = 0.75 * 0.2
COMPONENTS = ("outer_wall", "rooftop", "window")
TEMPERATURE = "openmeteo_hourly_temperature_2m"


@dataclass(frozen=True)
class Refurbishment:
    """Lifespan distribution of a component in years and the largest refurbished share."""

    mean: float
    spread: float
    quota: float = 1.0


def envelope_areas(b: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Wall (without windows), roof and window area per typed building."""
    sums = surfaces.groupBy(F.col("building_objectid").alias("objectid")).agg(
        F.sum(F.when(F.col("classname") == "WallSurface", F.col("area"))).alias("__wall"),
        F.sum(F.when(F.col("classname") == "RoofSurface", F.col("area"))).alias("roof_area"))
    window = F.col("floor_area") * F.col("floor_number") * WINDOW_SHARE
    return b.filter(F.col("building_type").isNotNull()).join(sums, "objectid", "left").withColumns(
        {"wall_area": F.col("__wall") - window, "window_area": window}).drop("__wall")


def sample_construction_year(b: DataFrame, seed, last_year: int, key: str = "objectid") -> DataFrame:
    """Period label -> uniform year of the period."""
    u = S.hash_uniform(f"{seed}:year", key)
    return b.withColumn("construction_year", S.year_from_class("construction_year", u, last_year))


def last_refurbishment(start: Column, key: Column, component: str, until: int, plan: Refurbishment, seed) -> Column:
    """Latest year <= until in the chain start + rounded normal draws, else start.

    Draws come from hashes, so a row does not depend on any other row. The chain stops at the first
    year beyond ``until``; the number of steps only bounds the array, and a chain that would need
    more raises.
    """
    steps = 2 * max(1, until - 1800) // max(1, int(plan.mean)) + 64
    zero = F.struct(start.cast("int").alias("now"), start.cast("int").alias("last"), F.lit(False).alias("over"))

    def draw(i):
        u1 = S.hash_uniform(f"{seed}:{component}:a", F.concat_ws(":", i.cast("string"), key))
        u2 = S.hash_uniform(f"{seed}:{component}:b", F.concat_ws(":", i.cast("string"), key))
        return F.rint(plan.mean + plan.spread * S.normal_from_uniform(u1, u2)).cast("int")

    def step(acc, i):
        return F.when(acc["over"], acc).otherwise(F.transform(
            F.array(acc["now"] + draw(i)), lambda y: F.struct(
                y.alias("now"), F.when(y <= until, F.greatest(acc["last"], y)).otherwise(acc["last"]).alias("last"),
                (y > until).alias("over")))[0])

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)
    return F.transform(F.array(end), lambda e: F.when(e["over"] | start.isNull(), e["last"]).otherwise(
        F.raise_error(F.lit("refurbishment chain did not end")).cast("int")))[0]


def simulate_refurbishment(b: DataFrame, until: int, plans: dict[str, Refurbishment], seed,
                           key: str = "objectid") -> DataFrame:
    return b.withColumns({
        name: last_refurbishment(F.col("construction_year"), F.col(key).cast("string"), name, until, plan, seed)
        for name, plan in plans.items()})


def harmonize_quota(b: DataFrame, plans: dict[str, Refurbishment], seed, key: str = "objectid") -> DataFrame:
    """At most round(quota * n) refurbished buildings per municipality and component.

    The surplus goes back to the construction year in hash order; the ranks are computed once for
    all components in long form.
    """
    names = list(plans)
    long = b.select(key, "ags", "construction_year", F.explode(F.array(*[
        F.struct(F.lit(n).alias("component"), F.col(n).alias("year"), F.lit(float(plans[n].quota)).alias("quota"))
        for n in names])).alias("c")).select(key, "ags", "construction_year", "c.*")
    totals = long.groupBy("ags", "component").agg(
        F.rint(F.first("quota") * F.count("*")).cast("bigint").alias("target"))
    done = long.filter("year <> construction_year")
    ranked = tables.rank_within(
        done, ["ags", "component"],
        [S.hash_uniform(F.concat_ws(":", F.lit(str(seed)), F.lit("quota"), F.col("component")), key), F.col(key)])
    surplus = tables.join_groups(ranked, totals, ["ags", "component"]).filter("rank > target").groupBy(key).agg(
        F.collect_set("component").alias("__back"))
    out = b.join(surplus, key, "left")
    return out.withColumns({n: F.when(
        F.coalesce(F.array_contains("__back", n), F.lit(False)), F.col("construction_year")).otherwise(F.col(n))
        for n in names}).drop("__back")


# ---------------------------------------------------------------- constructions

# Fixed heat transfer coefficients in W/(m2 K): element -> (outside, inside).
SURFACE_COEFFICIENTS = {
    "OuterWall": (25.0, 7.7), "Window": (25.0, 7.7), "Rooftop": (25.0, 7.7), "GroundFloor": (1000.0, 7.7),
    "InnerWall": (7.7, 7.7), "Ceiling": (6.7, 6.7), "Floor": (6.7, 6.7),
}
DAY_SECONDS = 86400.0


def _internal_capacity(thick, cond, dens, heat, r_inside: float, r_outside: float) -> float:
    """Areal heat capacity of the inner side for a daily cycle (ISO 13786 layer matrices).

    Layers run from outside to inside.
    """
    depth = np.sqrt(DAY_SECONDS / math.pi * cond / (dens * heat))
    ratio = thick / depth
    wave = (1 + 1j) * ratio
    total = np.array([[1, -r_inside], [0, 1]], dtype=complex)
    for d, k, w in zip(depth, cond, wave):
        # hyperbolic form of the layer matrix: cosh, sinh of the complex thickness
        c, s = np.cosh(w), np.sinh(w)
        layer = np.array([[c, -s * d / (k * (1 + 1j))], [-s * k * (1 + 1j) / d, c]])
        total = layer @ total
    total = np.array([[1, -r_outside], [0, 1]], dtype=complex) @ total
    return float(DAY_SECONDS / (2 * math.pi) * abs((total[1, 1] - 1) / total[0, 1]))


def catalogue(elements: DataFrame, layers: DataFrame, materials: DataFrame) -> DataFrame:
    """Elements x layers x materials without doors; the building type is the last name part."""
    return elements.filter(F.col("element_name") != "Door").join(layers, "element_id").join(
        materials, "material_id").select(
        F.regexp_replace("construction_data", "^.*_", "").alias("building_type"), "element_name", "construction_data",
        "start_year", "end_year", "material_name", "layer_index", "thickness", "thermal_conduc", "heat_capac", "density")


CONSTRUCTION_KEY = ["building_type", "element_name", "construction_data", "start_year", "end_year"]


def ordered_layers(rows: DataFrame) -> DataFrame:
    """Layers per construction from outside (highest index) to inside."""
    return rows.groupBy(*CONSTRUCTION_KEY).agg(F.sort_array(F.collect_list(F.struct(
        "layer_index", "material_name", "thickness", "thermal_conduc", "heat_capac", "density")), asc=False).alias("layers"))


def construction_table(rows: DataFrame) -> DataFrame:
    """Thermal resistance R and inner capacity C per construction; windows store no heat."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("R double, C double")
    def thermal(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for names, thick, cond, heat, dens in batches:
            out = []
            for name, d, k, c, rho in zip(names, thick, cond, heat, dens):
                outside, inside = SURFACE_COEFFICIENTS[name]
                r = float((d / k).sum()) + 1 / inside + 1 / outside
                cap = 0.0 if name == "Window" else _internal_capacity(d, k, rho, c, 1 / inside, 1 / outside)
                out.append((r, 0.0 if np.isnan(cap) else cap))
            yield pd.DataFrame(out, columns=["R", "C"])

    def values(field: str) -> Column:
        return F.transform("layers", lambda v: v[field].cast("double"))

    return ordered_layers(rows).withColumn("t", thermal(
        "element_name", values("thickness"), values("thermal_conduc"), values("heat_capac"), values("density"))).select(
        "building_type", "element_name", "construction_data", F.col("start_year").cast("int").alias("start_year"),
        F.col("end_year").cast("int").alias("end_year"), "t.R", "t.C")


def building_rc(b: DataFrame, constructions: DataFrame, ratio: float = 1.0, key: str = "objectid") -> DataFrame:
    """Resistance and capacitance per building from its seven parts.

    ``b``: floor_area, floor_number, wall_area, roof_area, window_area, building_type,
    construction_year and the refurbishment years rooftop, outer_wall, window.
    """
    storeys = F.greatest(F.col("floor_number") - 1, F.lit(1))
    built = F.col("construction_year")

    def part(name, area, year, envelope):
        generic = name in ("Ceiling", "Floor", "InnerWall")
        kind = F.lit("standard") if generic else F.col("building_type")
        data = F.lit("tabula_de_standard") if generic else F.concat(
            F.when(year == built, F.lit("tabula_de_standard_1_")).otherwise(F.lit("tabula_de_retrofit_1_")), F.col("building_type"))
        return F.struct(F.lit(name).alias("element_name"), area.cast("double").alias("area"), year.cast("int").alias("year"),
                        kind.alias("building_type"), data.alias("construction_data"), F.lit(envelope).alias("envelope"))

    parts = F.array(
        part("OuterWall", F.col("wall_area"), F.col("outer_wall"), True),
        part("Rooftop", F.col("roof_area"), F.col("rooftop"), True),
        part("Window", F.col("window_area"), F.col("window"), True),
        part("GroundFloor", F.col("floor_area"), built, True),
        part("Ceiling", F.col("floor_area") * storeys, built, False),
        part("Floor", F.col("floor_area") * storeys, built, False),
        part("InnerWall", F.col("floor_area") * storeys * 2.5, built, False))
    rows = b.select(key, F.explode(parts).alias("p")).select(key, "p.*")
    matched = tables.interval_or_nearest(
        rows, constructions, ["element_name", "building_type", "construction_data"], "year", [key, "element_name"])
    share = F.col("area") * ratio
    sums = matched.groupBy(key).agg(
        F.count("*").alias("__n"), F.count("area").alias("__known"),
        F.sum(F.when(F.col("envelope"), share / F.col("R"))).alias("__g"),
        F.sum(F.coalesce(F.col("C"), F.lit(0.0)) * share).alias("capacitance"))
    checked = b.select(key).join(sums, key, "left")
    missing = F.coalesce(F.col("__n"), F.lit(0)) < 7
    known = F.col("__known") == 7
    return checked.select(
        key,
        F.when(missing, F.raise_error(F.concat(F.lit("no construction for building "), F.col(key).cast("string"))).cast("double"))
        .when(known, 1 / F.col("__g")).alias("resistance"),
        F.when(known, F.col("capacitance")).alias("capacitance"))


# ---------------------------------------------------------------- demand


def _in_period(data: DataFrame, t_in: float, start: str, end: str) -> DataFrame:
    """Hours with heating need; the end is exclusive, so a last day may have to be added by the caller."""
    return data.filter((F.col("value") < t_in) & (F.col("time") >= F.lit(start).cast("timestamp"))
                       & (F.col("time") < F.lit(end).cast("timestamp")))


def annual_heat_demand(rc: DataFrame, links: DataFrame, meta: DataFrame, data: DataFrame, t_in: float,
                       start: str, end: str, variable: str = TEMPERATURE) -> DataFrame:
    """Demand in kWh and peak load per building.

    Hours are aggregated once per series and only then joined to the buildings. That is exact: the
    inner temperature is a constant and the resistance belongs to the building, so the sums factor
    out and the peak follows from the coldest (for a negative resistance, the warmest) hour.
    """
    series = meta.filter(F.col("name") == variable).select(F.col("id").alias("ts_metadata_id"))
    hours = _in_period(data, t_in, start, end).join(series, "ts_metadata_id", "left_semi").groupBy("ts_metadata_id").agg(
        F.count("value").alias("hours"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    r = F.col("resistance")
    per_link = rc.join(links.select(F.col("bld_objectid").alias("building_objectid"), "ts_metadata_id"), "building_objectid").join(
        hours, "ts_metadata_id")
    # a building normally has one temperature series; several are pooled as one set of hours
    pooled = per_link.groupBy("building_objectid", "resistance").agg(
        F.sum("hours").alias("hours"), F.sum(F.col("mean") * F.col("hours")).alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    return pooled.select(
        "building_objectid",
        (F.col("hours") / r * (t_in - F.col("total") / F.col("hours")) / 1000).alias("demand_kwh"),
        ((t_in - F.when(r > 0, F.col("low")).otherwise(F.col("high"))) / r).alias("pmax"))


def annual_heat_demand_direct(rc: DataFrame, links: DataFrame, meta: DataFrame, data: DataFrame, t_in: float,
                              start: str, end: str, variable: str = TEMPERATURE) -> DataFrame:
    """The same by joining every building with every hour; kept to measure the rewrite."""
    series = meta.filter(F.col("name") == variable).select(F.col("id").alias("ts_metadata_id"))
    hours = _in_period(data, t_in, start, end).join(series, "ts_metadata_id", "left_semi")
    joined = rc.join(links.select(F.col("bld_objectid").alias("building_objectid"), "ts_metadata_id"), "building_objectid").join(
        hours, "ts_metadata_id")
    return joined.groupBy("building_objectid", "resistance").agg(
        (F.count("value") / F.col("resistance") * (t_in - F.avg("value")) / 1000).alias("demand_kwh"),
        F.max((t_in - F.col("value")) / F.col("resistance")).alias("pmax")).drop("resistance")


def linear_heat_density(ways: DataFrame, links: DataFrame, demand: DataFrame) -> DataFrame:
    """Demand per metre of street; streets without buildings get zero.

    ``links``: building_id, street_id; ``demand``: building_objectid, demand_kwh.
    """
    total = links.join(demand, F.col("building_id").cast("string") == F.col("building_objectid").cast("string")).groupBy(
        "street_id").agg(F.sum("demand_kwh").alias("total_heat_demand"))
    streets = ways.filter(F.col("klasse") != "connection_line").select(
        F.col("id").alias("street_id"), *([c for c in ("geom",) if c in ways.columns]),
        F.col("length_geo").alias("street_length"), F.col("ags").alias("gemeindeschluessel"))
    out = streets.join(total, "street_id", "left").withColumn(
        "total_heat_demand", F.coalesce("total_heat_demand", F.lit(0.0)))
    return out.withColumn("linear_heat_density", F.when(
        F.col("street_length") > 0, F.col("total_heat_demand") / F.when(F.col("street_length") > 0, F.col("street_length"))
    ).otherwise(F.lit(0.0)))


def demand_overview(status: DataFrame, demand: DataFrame, rc: DataFrame, b: DataFrame) -> DataFrame:
    """Refurbishment state, demand, demand per floor area, thermal values and building columns."""
    shared = set(status.columns) - {"objectid"}
    extra = [c for c in b.columns if c not in shared and c != "objectid"]
    return status.join(demand, "building_objectid").join(rc, "building_objectid").join(
        b.select(F.col("objectid").alias("building_objectid"), *extra), "building_objectid").withColumn(
        "demand_per_area", F.try_divide("demand_kwh", F.col("floor_area") * F.col("floor_number")))


def heat_demand_of_buildings(b: DataFrame, surfaces: DataFrame, constructions: DataFrame, links: DataFrame, meta: DataFrame,
                  data: DataFrame, plans: dict[str, Refurbishment], year: int, t_in: float, ratio: float = 1.0,
                  seed: int = 42) -> dict[str, DataFrame]:
    """Areas, years, refurbishment, quota, thermal values and annual demand."""
    from ..session import cut_lineage

    status = sample_construction_year(envelope_areas(b, surfaces), seed, year)
    status = cut_lineage(harmonize_quota(cut_lineage(simulate_refurbishment(status, year, plans, seed)), plans, seed))
    rc = cut_lineage(building_rc(status, constructions, ratio)).withColumnRenamed("objectid", "building_objectid")
    demand = annual_heat_demand(rc, links, meta, data, t_in, f"{year}-01-01", f"{year}-12-31")
    return {"status": status, "rc": rc, "demand": demand}
