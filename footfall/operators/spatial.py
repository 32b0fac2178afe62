"""Spatial joins as equi-joins on grid buckets with an exact check."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.constants import EARTH_M
from footfall.functions.geo import contains, covers, haversine_m, ring_bounds
from footfall.functions.polygons import in_polygon, polygon_bounds
from footfall.sources.shared import checkpointed

METRES_PER_DEGREE = math.radians(1) * EARTH_M
#: Levels of cubes below those of the size that a search starts with, for places where targets are dense.
FINER = 10


def bucket(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Points of an inclusive box; plain comparisons, so Parquet can skip by them."""
    xmin, ymin, xmax, ymax = box
    return lon.between(xmin, xmax) & lat.between(ymin, ymax)


def overlaps_bbox(xmin: Column, ymin: Column, xmax: Column, ymax: Column, box: tuple[float, float, float, float]) -> Column:
    """Extents that meet an inclusive box."""
    return (xmax >= box[0]) & (xmin <= box[2]) & (ymax >= box[1]) & (ymin <= box[3])


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, inclusive: bool = True, size: float = 0.05, how: str = "inner"
) -> DataFrame:
    """``points`` (lon, lat) joined to the ``polygons`` (ring, or rings with holes and parts) that hold them.

    A polygon is listed under every grid bucket of its bounds, so each point
    meets the polygons of its own bucket only. With ``inclusive`` a boundary
    belongs to the polygon. Columns of both sides are kept; names must differ.
    """
    several = "rings" in polygons.columns
    box = polygon_bounds(F.col("rings")) if several else ring_bounds(F.col("ring"))
    listed = (
        polygons.withColumn("_box", box)
        .withColumn("_gx", F.explode(F.sequence(bucket(F.col("_box.xmin"), size), bucket(F.col("_box.xmax"), size))))
        .withColumn("_gy", F.explode(F.sequence(bucket(F.col("_box.ymin"), size), bucket(F.col("_box.ymax"), size))))
    )
    if several:
        inside = in_polygon(F.col("lon"), F.col("lat"), F.col("rings"), inclusive)
    else:
        inside = (covers if inclusive else contains)(F.col("lon"), F.col("lat"), F.col("ring"))
    placed = points.withColumn("_px", bucket(F.col("lon"), size)).withColumn("_py", bucket(F.col("lat"), size))
    near = F.col("lon").between(F.col("_box.xmin"), F.col("_box.xmax")) & F.col("lat").between(
        F.col("_box.ymin"), F.col("_box.ymax")
    )
    on = (F.col("_px") == F.col("_gx")) & (F.col("_py") == F.col("_gy")) & near & inside
    return placed.join(listed, on, how).drop("_px", "_py", "_gx", "_gy", "_box")


def within_radius(
    left: DataFrame, right: DataFrame, metres: float, keys: list[str] | None = None
) -> DataFrame:
    """Pairs of ``left`` (lat, lon) and ``right`` (r_lat, r_lon) at most ``metres`` apart, with distance_m.

    Each right row is listed under the 3 x 3 buckets around it, the bucket being
    as wide as the radius at the highest latitude met; ``keys`` are equal on
    both sides too.
    """
    lat_size = metres / METRES_PER_DEGREE * 1.000001
    # a degree of longitude shrinks towards the poles: bands of a degree of latitude have their own width
    band = F.floor(F.abs(F.col("_lat"))) + 1
    lon_size = F.lit(lat_size) / F.greatest(F.cos(F.radians(F.least(band + 1, F.lit(89.0)))), F.lit(0.0174))
    l = left.withColumn("_lat", F.col("lat"))
    l = l.withColumn("_y", bucket(F.col("lat"), lat_size)).withColumn("_band", band).withColumn(
        "_x", F.floor(F.col("lon") / lon_size).cast("long")
    )
    r = right.withColumn("_r_lat", F.col("r_lat"))
    low, high = F.col("r_lat") - lat_size, F.col("r_lat") + lat_size
    least = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    bands = F.sequence(F.floor(least) + 1, F.floor(F.greatest(F.abs(low), F.abs(high))) + 1)
    r = r.withColumn("_r_band", F.explode(bands))
    r_size = F.lit(lat_size) / F.greatest(F.cos(F.radians(F.least(F.col("_r_band") + 1, F.lit(89.0)))), F.lit(0.0174))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    r = (
        r.withColumn("_r_x0", F.floor(F.col("r_lon") / r_size).cast("long"))
        .withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .withColumn("_r_x", F.col("_r_x0") + F.col("_dx"))
        .withColumn("_r_y", bucket(F.col("r_lat"), lat_size) + F.col("_dy"))
    )
    on = (F.col("_x") == F.col("_r_x")) & (F.col("_y") == F.col("_r_y")) & (F.col("_band") == F.col("_r_band"))
    for k in keys or []:
        on = on & (l[k] == r[f"r_{k}"])
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    pairs = l.join(r, on).withColumn("distance_m", distance).where(F.col("distance_m") <= metres)
    return pairs.drop("_lat", "_y", "_x", "_band", "_r_lat", "_r_band", "_r_x0", "_dx", "_dy", "_r_x", "_r_y")


def sphere_axes(lat: str, lon: str) -> list[Column]:
    """Places on the unit sphere, moved so that no coordinate is negative."""
    up, east = F.radians(lat), F.radians(lon)
    return [F.cos(up) * F.cos(east) + 1, F.cos(up) * F.sin(east) + 1, F.sin(up) + 1]


def pyramid_levels(cubes: DataFrame, targets: DataFrame, k: int, top: int, same: Sequence[str] = ()) -> DataFrame:
    """``cubes`` (columns c0, c1, ...) with ``level``, the lowest at which theirs holds ``k`` targets; ``top`` where none does.

    Only targets with equal columns ``same`` count.

    Cubes of a level are pairs of those below in every axis, so the counts of
    all levels come from those of the lowest one, and both sides shrink to
    their occupied cubes before anything is joined.
    """
    axes = [c for c in cubes.columns if c not in same]

    def lifted(df):
        steps = F.sequence(F.lit(0), F.lit(top))
        up = df.withColumn("level", F.explode(steps))
        return up.select(*[c for c in df.columns if c not in axes], "level", *[F.call_function("shiftright", F.col(a), F.col("level")).alias(f"u{a}") for a in axes], *axes)

    keys = [*same, "level", *[f"u{a}" for a in axes]]
    counts = lifted(targets.groupBy(*same, *axes).agg(F.count(F.lit(1)).alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))
    enough = counts.where((F.col("n") >= k) | (F.col("level") == top)).select(*keys)
    return lifted(cubes.distinct()).join(enough, keys).groupBy(*same, *axes).agg(F.min("level").alias("level"))


def candidate_pairs(
    points: DataFrame, targets: DataFrame, axes: tuple[list[Column], list[Column]], k: int, size: float, extent: float, same: Sequence[str] = ()
) -> DataFrame:
    """Pairs of ``points`` and ``targets`` among which every point has its ``k`` nearest, with ``reach``.

    With columns ``same``, which both sides have, only pairs that agree in them.

    ``axes`` are the coordinates of both sides, from 0 to ``extent``; ``size``
    is a cube's side where targets are neither dense nor sparse, and the
    lowest level is FINER levels below. A cube with ``k`` targets has them
    within its diagonal, ``reach``, of each of its places; a point then meets
    the cubes four times as wide that come within its reach. Points for which
    no cube has enough meet all targets, which are then fewer than ``k`` in
    each half of every axis.
    """
    n = len(axes[0])
    size = size / 2**FINER
    top = max(1, math.ceil(math.log2(extent / size)) + 1)
    names = [f"c{i}" for i in range(n)]
    near = targets.select("*", *[bucket(v, size).alias(c) for v, c in zip(axes[1], names)])
    placed = points.select("*", *[v.alias(f"_x{i}") for i, v in enumerate(axes[0])]).select("*", *[bucket(F.col(f"_x{i}"), size).alias(c) for i, c in enumerate(names)])
    levels = checkpointed(pyramid_levels(placed.select(*same, *names), near.select(*same, *names), k, top, same))
    used = sorted(r["level"] for r in levels.select("level").distinct().collect())
    diagonal = math.sqrt(n) * size * 1.000001
    placed = placed.join(levels, [*same, *names]).withColumn("reach", F.when(F.col("level") < top, F.pow(F.lit(2.0), F.col("level")) * diagonal).otherwise(F.lit(float("inf"))))
    placed = placed.withColumn("_up", F.least(F.col("level") + 2, F.lit(top)))
    last = math.floor(extent / size)
    for i in range(n):
        low, high = (bucket(F.when(F.col("level") < top, F.col(f"_x{i}") + sign * F.col("reach")).otherwise(end), size) for sign, end in ((-1, 0.0), (1, extent)))
        step = lambda v: F.call_function("shiftright", F.greatest(F.lit(0), F.least(F.lit(last), v)).cast("long"), F.col("_up"))
        placed = placed.withColumn(f"_k{i}", F.explode(F.sequence(step(low), step(high))))
    listed = near.withColumn("_up", F.explode(F.array(*[F.lit(u) for u in sorted({min(u + 2, top) for u in used})] or [F.lit(-1)])))
    listed = listed.select(*targets.columns, "_up", *[F.call_function("shiftright", F.col(c), F.col("_up")).alias(f"_k{i}") for i, c in enumerate(names)])
    drop = [*names, "level", "_up", *[f"_x{i}" for i in range(n)], *[f"_k{i}" for i in range(n)]]
    return placed.join(listed, [*same, "_up", *[f"_k{i}" for i in range(n)]]).drop(*drop)


def nearest_k(points: DataFrame, targets: DataFrame, k: int = 2, start_m: float = 500.0) -> DataFrame:
    """The ``k`` nearest ``targets`` (target_id, r_lat, r_lon) of every point (point_id, lat, lon).

    Counts of targets in a pyramid of cubes around the sphere say how far each
    point has to look, so one join finds them all: dense regions look within
    ``start_m`` or so, sparse ones farther, across poles and antimeridian too.
    Ties go to the smaller target_id. Columns: point_id, target_id,
    distance_m, place (from 1). Points for which there are fewer than ``k``
    targets anywhere get what there is, points without a place get nothing.
    """
    left = points.select("point_id", "lat", "lon").where("lat is not null and lon is not null")
    near = targets.select("target_id", "r_lat", "r_lon").where("r_lat is not null and r_lon is not null")
    # points of one place have the same targets, and of targets of one place only the first k can be among them
    first = Window.partitionBy("r_lat", "r_lon").orderBy("target_id")
    near = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    axes = sphere_axes("lat", "lon"), sphere_axes("r_lat", "r_lon")
    pairs = candidate_pairs(left.select("lat", "lon").distinct(), near, axes, k, min(start_m / EARTH_M, 1.0), 2.0)
    pairs = pairs.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    pairs = pairs.where(2 * F.sin(F.col("distance_m") / (2 * EARTH_M)) <= F.col("reach"))
    order = Window.partitionBy("lat", "lon").orderBy("distance_m", "target_id")
    ranked = pairs.select("lat", "lon", "target_id", "distance_m", F.row_number().over(order).cast("long").alias("place")).where(F.col("place") <= k)
    return left.join(ranked, ["lat", "lon"]).select("point_id", "target_id", "distance_m", "place")


def nearest_by_degrees(points: DataFrame, targets: DataFrame, k: int, start: float = 0.005) -> DataFrame:
    """The ``k`` nearest of the plane of unscaled degrees: point_id, target_id, degrees2, place, and the columns of ``targets``.

    Ties go to the smaller target_id; latitudes and longitudes are those of a map, without its seams.
    """
    left = points.where("lat between -90 and 90 and lon between -540 and 540")
    near = targets.where("r_lat between -90 and 90 and r_lon between -540 and 540")
    axes = [F.col("lat") + 540, F.col("lon") + 540], [F.col("r_lat") + 540, F.col("r_lon") + 540]
    pairs = candidate_pairs(left, near, axes, k, start, 1080.0)
    pairs = pairs.withColumn("degrees2", (F.col("lat") - F.col("r_lat")) ** 2 + (F.col("lon") - F.col("r_lon")) ** 2)
    order = Window.partitionBy("point_id").orderBy("degrees2", "target_id")
    ranked = pairs.where(F.col("degrees2") <= F.col("reach") * F.col("reach")).drop("reach").withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("place") <= k)
