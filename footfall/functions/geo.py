"""Geometry as Column expressions: distance, projection, rings and lines.

A ring or line is ``array<struct<x double, y double>>`` with x the longitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.constants import EARTH_M, LCC


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2)
    )
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def _lcc_constants() -> tuple[float, float, float, float]:
    f = 1 / LCC["inverse_flattening"]
    e = math.sqrt(2 * f - f * f)

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi):
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    p0, p1, p2 = (math.radians(LCC[k]) for k in ("lat0", "lat1", "lat2"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = m(p1) / (n * t(p1) ** n)
    return e, n, scale, LCC["a"] * scale * t(p0) ** n


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north in the state plane."""
    e, n, scale, rho0 = _lcc_constants()
    phi = F.radians(lat)
    s = F.sin(phi) * e
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho = F.pow(t, F.lit(n)) * (LCC["a"] * scale)
    theta = (F.radians(lon) - math.radians(LCC["lon0"])) * n
    return rho * F.sin(theta) + LCC["x0"], F.lit(rho0) - rho * F.cos(theta) + LCC["y0"]


def unproject(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """Latitude and longitude of state-plane metres."""
    e, n, scale, rho0 = _lcc_constants()
    dx, dy = x - LCC["x0"], F.lit(rho0) - (y - LCC["y0"])
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (LCC["a"] * scale), F.lit(1 / n))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(rounds):
        s = F.sin(phi) * e
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.degrees(phi), F.degrees(F.atan2(dx, dy) / n) + LCC["lon0"]


def project_ring(ring: Column) -> Column:
    def one(p):
        x, y = project(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, one)


def _sides(ring: Column) -> Column:
    """Pairs of consecutive vertices, the last one leading back to the first."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("p"), following.alias("q"))


def signed_area(ring: Column) -> Column:
    """Shoelace area; positive for counter-clockwise rings."""
    return F.aggregate(
        _sides(ring),
        F.lit(0.0),
        lambda acc, s: acc + (s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]) / 2,
    )


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid x and y of a ring with some area; of its first vertex otherwise."""
    x0, y0 = ring[0]["x"], ring[0]["y"]

    def moment(axis):
        def add(acc, s):
            cross = (s["p"]["x"] - x0) * (s["q"]["y"] - y0) - (s["q"]["x"] - x0) * (s["p"]["y"] - y0)
            origin = x0 if axis == "x" else y0
            return acc + (s["p"][axis] + s["q"][axis] - 2 * origin) * cross

        return F.aggregate(_sides(ring), F.lit(0.0), add)

    area = signed_area(F.transform(ring, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y"))))
    x = F.when(area != 0, x0 + moment("x") / (6 * area)).otherwise(x0)
    y = F.when(area != 0, y0 + moment("y") / (6 * area)).otherwise(y0)
    return x, y


def on_boundary(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point lies on a side of the ring."""

    def on(s):
        p, q = s["p"], s["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (
            (cross == 0)
            & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"]))
            & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        )

    return F.exists(_sides(ring), on)


def _crossings_odd(x: Column, y: Column, ring: Column) -> Column:
    def crosses(s):
        p, q = s["p"], s["q"]
        span = q["y"] - p["y"]
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(span, F.lit(0.0))
        return ((p["y"] > y) != (q["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(_sides(ring), crosses)) % 2 == 1


def contains(x: Column, y: Column, ring: Column) -> Column:
    """Inside and not on the boundary."""
    return _crossings_odd(x, y, ring) & ~on_boundary(x, y, ring)


def covers(x: Column, y: Column, ring: Column) -> Column:
    """Inside or on the boundary."""
    return _crossings_odd(x, y, ring) | on_boundary(x, y, ring)


def distance_to_ring(x: Column, y: Column, ring: Column) -> Column:
    """Distance to the nearest side in the ring's units."""

    def to_side(s):
        p, q = s["p"], s["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        length2 = dx * dx + dy * dy
        t = F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(length2, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        ex, ey = x - p["x"] - t * dx, y - p["y"] - t * dy
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(F.transform(_sides(ring), to_side))


def covered_within(lat: Column, lon: Column, ring: Column, metres: float) -> Column:
    """Covered by the ring or within ``metres`` of it in the state plane: its buffer."""
    x, y = project(lat, lon)
    return covers(lon, lat, ring) | (distance_to_ring(x, y, project_ring(ring)) <= metres)


def ring_bounds(ring: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")
    )


def parse_line(wkt: Column) -> Column:
    """Vertices of a WKT LINESTRING; null for anything else."""
    body = F.regexp_extract(wkt, r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    parts = F.split(F.trim(body), r"\s*,\s*")
    points = F.transform(
        parts,
        lambda p: F.struct(
            F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"),
            F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y"),
        ),
    )
    return F.when(body != "", points)


def parse_polygon(wkt: Column) -> Column:
    """Outer ring of a WKT POLYGON, without the closing vertex; null for anything else."""
    body = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1)
    parts = F.split(F.trim(body), r"\s*,\s*")
    points = F.transform(
        parts,
        lambda p: F.struct(
            F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"),
            F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y"),
        ),
    )
    open_ring = F.when(
        (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1)),
        F.slice(points, F.lit(1), F.size(points) - 1),
    ).otherwise(points)
    return F.when(body != "", open_ring)


def cumulative_m(line: Column) -> Column:
    """Metres from the start at every vertex."""

    def add(acc, s):
        step = haversine_m(s["p"]["y"], s["p"]["x"], s["q"]["y"], s["q"]["x"])
        return F.concat(acc, F.array(F.element_at(acc, -1) + step))

    n = F.size(line)
    pairs = F.arrays_zip(F.slice(line, F.lit(1), n - 1).alias("p"), F.slice(line, F.lit(2), n - 1).alias("q"))
    return F.aggregate(pairs, F.array(F.lit(0.0)), add)


def line_length_m(line: Column) -> Column:
    return F.element_at(cumulative_m(line), -1)


def _clamped(at: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))


def portion_m(total_m: Column, at_a: Column, at_b: Column) -> Column:
    """Metres between two positions (shares of the length) on a line."""
    return F.abs(_clamped(at_b) - _clamped(at_a)) * total_m


def point_at(line: Column, cumulative: Column, at: Column) -> Column:
    """struct<x, y> at a share of the line's length, between vertices by degrees."""
    total = F.element_at(cumulative, -1)
    target = _clamped(at) * total
    # the first vertex, after the start, that isn't short of the target
    k = F.size(F.filter(F.slice(cumulative, F.lit(2), F.size(cumulative) - 1), lambda c: c < target)) + 2
    k = F.least(k, F.size(line))
    p, q = F.element_at(line, k - 1), F.element_at(line, k)
    span = F.element_at(cumulative, k) - F.element_at(cumulative, k - 1)
    t = F.coalesce((target - F.element_at(cumulative, k - 1)) / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    inner = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
    return F.when(total > 0, inner).otherwise(F.element_at(line, 1))
