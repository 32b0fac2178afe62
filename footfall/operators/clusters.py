"""Clusters of points for the zoom levels of a map, every level from the finer one."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.sources.shared import checkpointed

# Pixels of the world's width at zoom 0, a cluster's radius in pixels, and the zoom up to which points are clustered.
WORLD_PIXELS, RADIUS_PIXELS, CLUSTER_MAX_ZOOM = 512, 40, 12
#: Bits of a place's coordinates in the world square.
BITS = 40


def world_place(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator coordinates in whole units of 2 ** -40 of the world's width, from the north-west corner."""
    up = F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat)))
    x = (lon + 180) / 360
    y = F.lit(0.5) - F.log(F.tan(F.lit(math.pi / 4) + up / 2)) / (2 * math.pi)
    return tuple(F.floor(v * float(1 << BITS)).cast("long") for v in (x, y))


def side(zoom: int) -> int:
    """Side of a cluster's square at a zoom, in those units; it doubles with every level down."""
    return RADIUS_PIXELS * (1 << BITS) // WORLD_PIXELS >> zoom


def cluster_levels(points: DataFrame, max_zoom: int = CLUSTER_MAX_ZOOM) -> DataFrame:
    """zoom, cx, cy, points, lat and lon of the clusters of ``points`` (lat, lon), from ``max_zoom`` down to 0.

    A cluster holds the points of a square as wide as the radius, and its place
    is their mean in the map's plane. Squares of a level are four of the finer
    one, so each level adds up the one before, and a point is in one cluster
    of each: that of :func:`cluster_of`. Points without a place are in none.
    """
    x, y = world_place(F.col("lat"), F.col("lon"))
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").select(x.alias("x"), y.alias("y"))
    squares = [F.floor(F.col(c) / F.lit(side(max_zoom))).cast("long").alias(f"c{c}") for c in "xy"]
    level = placed.groupBy(*squares).agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    levels = [checkpointed(level)]
    for _ in range(max_zoom):
        up = [F.call_function("shiftright", F.col(c), F.lit(1)).alias(c) for c in ("cx", "cy")]
        level = levels[-1].groupBy(*up).agg(*[F.sum(c).alias(c) for c in ("points", "sx", "sy")])
        levels.append(checkpointed(level))
    every = reduce(DataFrame.unionByName, [df.withColumn("zoom", F.lit(max_zoom - k)) for k, df in enumerate(levels)])
    mean = {c: F.col(f"s{c}") / F.col("points") / float(1 << BITS) for c in "xy"}
    lat = F.degrees(2 * F.atan(F.exp((F.lit(0.5) - mean["y"]) * (2 * math.pi))) - math.pi / 2)
    return every.select("zoom", "cx", "cy", "points", lat.alias("lat"), (mean["x"] * 360 - 180).alias("lon"))


def cluster_of(lat: Column, lon: Column, zoom: int) -> Column:
    """struct<cx, cy> of the cluster of a place at a zoom."""
    return F.struct(*[F.floor(v / F.lit(side(zoom))).cast("long").alias(c) for v, c in zip(world_place(lat, lon), ("cx", "cy"))])
