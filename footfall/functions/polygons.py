"""Polygons of several rings: overlays by scanline.

A polygon is an array of rings, each an array of vertices that isn't closed; a
place is inside where an odd number of rings surround it, so holes and separate
parts need no order. Overlays cut the plane into strips between all heights at
which a side begins, ends or crosses another. Within a strip the sides stand in
one order from left to right, and what lies between two of them is in or out as
a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions import geo

#: Sides that are tested for crossings at a time.
BLOCK = 512
#: Digits after the point to which corners of a result are matched.
DIGITS = 12

Rings = list[np.ndarray]


def sides_of(polygon: Rings) -> np.ndarray:
    """Sides (x0, y0, x1, y1) with y0 < y1; level ones bound nothing in a strip."""
    parts = [np.c_[r, np.roll(r, -1, axis=0)] for r in polygon if len(r) > 2]
    s = np.concatenate(parts) if parts else np.zeros((0, 4))
    s = s[s[:, 1] != s[:, 3]]
    down = s[:, 1] > s[:, 3]
    s[down] = s[down][:, [2, 3, 0, 1]]
    return s


def _crossing_heights(s: np.ndarray) -> np.ndarray:
    """Heights at which two sides cross between their ends."""
    found = [np.zeros(0)]
    dx, dy = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
    for at in range(0, len(s), BLOCK):
        a = slice(at, at + BLOCK)
        det = dx[a, None] * dy[None] - dy[a, None] * dx[None]
        ex, ey = s[None, :, 0] - s[a, None, 0], s[None, :, 1] - s[a, None, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ex * dy[None] - ey * dx[None]) / det
            u = (ex * dy[a, None] - ey * dx[a, None]) / det
        hit = (det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        found.append((s[a, None, 1] + t * dy[a, None])[hit])
    return np.concatenate(found)


def strips(polygons: list[Rings], inside: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """Trapezoids (y0, y1, left0, right0, left1, right1) of each strip, from below, that make up the overlay.

    ``inside`` tells from an array of (place, polygon) flags which places belong to it.
    """
    sides = [sides_of(p) for p in polygons]
    owner = np.repeat(np.arange(len(sides)), [len(s) for s in sides])
    s = np.concatenate(sides) if sides else np.zeros((0, 4))
    low, high = -np.inf, np.inf
    if inside is both and all(map(len, sides)):
        # what all share lies between these heights, and no side to the right of it matters
        low, high = max(x[:, 1].min() for x in sides), min(x[:, 3].max() for x in sides)
        kept = (s[:, 3] > low) & (s[:, 1] < high) & (np.minimum(s[:, 0], s[:, 2]) <= min(x[:, ::2].max() for x in sides))
        s, owner = s[kept], owner[kept]
    heights = np.unique(np.r_[s[:, 1], s[:, 3], _crossing_heights(s)])
    heights = heights[(heights >= low) & (heights <= high)]
    if np.isfinite(low) and low < high:
        heights = np.unique(np.r_[low, heights, high])
    order = np.argsort(s[:, 1], kind="stable")
    s, owner = s[order], owner[order]
    for y0, y1 in zip(heights, heights[1:]):
        started = np.searchsorted(s[:, 1], y0, "right")
        live = np.flatnonzero(s[:started, 3] >= y1)
        own = s[live]
        slope = (own[:, 2] - own[:, 0]) / (own[:, 3] - own[:, 1])
        at0 = np.where(own[:, 1] == y0, own[:, 0], own[:, 0] + slope * (y0 - own[:, 1]))
        at1 = np.where(own[:, 3] == y1, own[:, 2], own[:, 0] + slope * (y1 - own[:, 1]))
        rank = np.argsort(at0 + at1, kind="stable")
        flags = np.zeros((len(rank), len(polygons)), np.int64)
        flags[np.arange(len(rank)), owner[live[rank]]] = 1
        state = np.cumsum(flags, axis=0) % 2 == 1
        change = np.flatnonzero(np.diff(np.r_[0, inside(state).astype(int)]) if len(rank) else [])
        left, right = rank[change[::2]], rank[change[1::2]]
        # polygons that touch along a side make one stretch
        apart = np.r_[True, (at0[right[:-1]] != at0[left[1:]]) | (at1[right[:-1]] != at1[left[1:]])][: len(left)]
        left, right = left[apart], right[np.r_[apart[1:], True][: len(right)]]
        if len(left):
            yield np.stack([np.full(len(left), y0), np.full(len(left), y1), at0[left], at0[right], at1[left], at1[right]], axis=1)


def both(state: np.ndarray) -> np.ndarray:
    return state.all(axis=1)


def either(state: np.ndarray) -> np.ndarray:
    return state.any(axis=1)


def first_only(state: np.ndarray) -> np.ndarray:
    return state[:, 0] & ~state[:, 1:].any(axis=1)


OVERLAYS = {"intersection": both, "union": either, "difference": first_only}


def area_of(trapezoids: np.ndarray) -> float:
    t = trapezoids
    return float(((t[:, 3] - t[:, 2] + t[:, 5] - t[:, 4]) * (t[:, 1] - t[:, 0])).sum() / 2)


def point_of(trapezoids: np.ndarray) -> tuple[float, float] | None:
    """A place well inside: the middle of the trapezoid with most room both ways."""
    t = trapezoids
    if not len(t):
        return None
    wide, high = (t[:, 3] - t[:, 2] + t[:, 5] - t[:, 4]) / 2, t[:, 1] - t[:, 0]
    y0, y1, a, b, c, d = t[np.argmax(np.minimum(wide, high))]
    return float((a + b + c + d) / 4), float((y0 + y1) / 2)


def _level_sides(below: np.ndarray, above: np.ndarray, y: float) -> list[tuple]:
    """Level parts of the outline between two strips: where only one of them is covered."""
    ends = np.unique(np.r_[below[:, 4:6].ravel(), above[:, 2:4].ravel()])
    out = []
    for x0, x1 in zip(ends, ends[1:]):
        mid = (x0 + x1) / 2
        up = bool(((above[:, 2] < mid) & (mid < above[:, 3])).any())
        down = bool(((below[:, 4] < mid) & (mid < below[:, 5])).any())
        if up != down:
            out.append((x0, y, x1, y) if up else (x1, y, x0, y))
    return out


def rings_of(layers: list[np.ndarray]) -> Rings:
    """The outline of strips' trapezoids: rings with the inside on the left, straight corners left out."""
    none = np.zeros((0, 6))
    outline: list[tuple] = []
    last, top = none, None
    for t in layers:
        y0, y1 = t[0, 0], t[0, 1]
        if top is not None and top != y0:
            outline += _level_sides(last, none, top)
            last = none
        outline += _level_sides(last, t, y0)
        for _, _, a, b, c, d in t:
            outline += [(b, y0, d, y1), (c, y1, a, y0)]
        last, top = t, y1
    if top is not None:
        outline += _level_sides(last, none, top)
    after: dict[tuple, list[tuple]] = {}
    for x0, y0, x1, y1 in outline:
        p, q = (round(x0, DIGITS), round(y0, DIGITS)), (round(x1, DIGITS), round(y1, DIGITS))
        if p != q:
            after.setdefault(p, []).append(q)
    rings = []
    while after:
        ring = [next(iter(after))]
        while (ends := after.get(ring[-1])) and (len(ring) < 2 or ring[-1] != ring[0]):
            ring.append(ends.pop())
            if not ends:
                del after[ring[-2]]
        ring = np.array(ring[:-1])
        to, back = np.roll(ring, -1, axis=0) - ring, ring - np.roll(ring, 1, axis=0)
        bend = np.abs(to[:, 0] * back[:, 1] - to[:, 1] * back[:, 0]) > 1e-9 * np.hypot(*to.T) * np.hypot(*back.T)
        if bend.sum() > 2:
            rings.append(ring[bend])
    return rings


def overlay(polygons: list[Rings], how: str = "intersection") -> list[np.ndarray]:
    """The strips of an overlay of polygons."""
    return list(strips(polygons, OVERLAYS[how]))


def decode(value) -> Rings:
    """Rings of a column made by :func:`flat`."""
    return [np.asarray(r, float).reshape(-1, 2) for r in value] if value is not None else []


def flat(rings: Column) -> Column:
    """Rings as arrays of x, y, x, y, ..., the form in which tasks get them."""
    return F.transform(rings, lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"]))))


def shaped(flat_rings: Column) -> Column:
    """Rings of arrays of x, y, x, y, ..."""

    def one(r):
        at = F.sequence(F.lit(0), F.size(r) - 2, F.lit(2))
        return F.transform(at, lambda i: F.struct(F.get(r, i).alias("x"), F.get(r, i + 1).alias("y")))

    return F.transform(flat_rings, one)


def encode(rings: Rings) -> list[list[float]]:
    return [r.ravel().tolist() for r in rings]


def _with_both(result: str, make: Callable[[Rings, Rings], object]):
    """A column function of two polygons; null where one of them is null."""

    @F.pandas_udf(result)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([make(decode(a), decode(b)) if a is not None and b is not None else None for a, b in zip(left, right)], dtype=object)

    return lambda a, b: run(flat(a), flat(b))


def overlay_rings(a: Column, b: Column, how: str = "intersection") -> Column:
    """Rings of the intersection, union or difference of two polygons; no rings where it is empty."""
    return shaped(_with_both("array<array<double>>", lambda p, q: encode(rings_of(overlay([p, q], how))))(a, b))


def overlay_area(a: Column, b: Column, how: str = "intersection") -> Column:
    """Area of the intersection, union or difference of two polygons."""
    return _with_both("double", lambda p, q: sum(map(area_of, overlay([p, q], how))))(a, b)


def overlay_facts(a: Column, b: Column, how: str = "intersection") -> Column:
    """struct<area, x, y> of an overlay: its area, and a place well inside it; null where it is empty."""

    def make(p: Rings, q: Rings):
        t = overlay([p, q], how)
        if t:
            t = np.concatenate(t)
            return [area_of(t), *point_of(t)]
        return None

    facts = _with_both("array<double>", make)(a, b)
    return F.when(facts.isNotNull(), F.struct(facts[0].alias("area"), facts[1].alias("x"), facts[2].alias("y")))


def polygon_area(rings: Column) -> Column:
    """Area by parity of rings: holes are left out, parts are added up."""
    return overlay_area(rings, rings, "union")


def polygon_sides(rings: Column) -> Column:
    """All sides of all rings as structs of p and q."""
    return F.flatten(F.transform(rings, geo._sides))


def polygon_bounds(rings: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax> of all rings."""
    return geo.ring_bounds(F.flatten(rings))


def in_polygon(x: Column, y: Column, rings: Column, inclusive: bool = True) -> Column:
    """Whether an odd number of rings surround the place; ``inclusive``, the boundaries of all rings, holes' too, belong to it."""
    within = F.aggregate(rings, F.lit(False), lambda odd, r: odd != geo._crossings_odd(x, y, r))
    edge = F.exists(rings, lambda r: geo.on_boundary(x, y, r))
    return within | edge if inclusive else within & ~edge


def polygon_centroid(rings: Column) -> tuple[Column, Column]:
    """Centroid x and y by parity for rings that turn as GeoJSON's do, outer ones one way and holes the other.

    Rings are weighed by their signed areas; without any area it is the first vertex.
    """

    def part(r):
        x, y = geo.ring_centroid(r)
        return F.struct(geo.signed_area(r).alias("a"), x.alias("x"), y.alias("y"))

    parts = F.transform(rings, part)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["a"])

    def mean(axis):
        return F.when(total != 0, F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["a"] * p[axis]) / total).otherwise(rings[0][0][axis])

    return mean("x"), mean("y")


def project_rings(rings: Column) -> Column:
    return F.transform(rings, geo.project_ring)


def parse_rings(wkt: Column) -> Column:
    """All rings of a WKT POLYGON or MULTIPOLYGON, unclosed; null for anything else."""
    kind = wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON\s*\(")
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def ring(body):
        numbers = F.transform(F.split(F.trim(body), r"\s*,\s*|\s+"), lambda v: v.try_cast("double"))
        at = F.sequence(F.lit(0), F.size(numbers) - 2, F.lit(2))
        vertices = F.transform(at, lambda i: F.struct(F.get(numbers, i).alias("x"), F.get(numbers, i + 1).alias("y")))
        shut = (F.size(vertices) > 1) & (F.element_at(vertices, 1) == F.element_at(vertices, -1))
        return F.when(shut, F.slice(vertices, F.lit(1), F.size(vertices) - 1)).otherwise(vertices)

    return F.when(kind, F.transform(bodies, ring))
