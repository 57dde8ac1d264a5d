"""Clipping of layers to areas: what lies in several areas counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import spatial
from .overlay import clip_lines, clip_multi, dissolve  # noqa: F401


def clip_points(df: DataFrame, geom: str, areas: DataFrame, poly: str) -> DataFrame:
    """Points inside any area or on its edge."""
    keyed = df.withColumn("__k", F.struct(geom))
    hit = spatial.points_in_polygons(keyed.select("__k", geom).distinct(), areas.select(poly), geom, poly, boundary=True).select("__k").distinct()
    return keyed.join(hit, "__k", "left_semi").drop("__k")
