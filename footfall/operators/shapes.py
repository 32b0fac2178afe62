"""Polygon joins: unions of any number of polygons, clipping, and the town of a shape.

Polygons meet on a grid of tiles. ``rings`` are those of
:mod:`footfall.functions.polygons`, with holes and parts, in any plane;
``size`` is a tile's side in that plane's unit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import geo, polygons
from footfall.operators.spatial import bucket
from footfall.ship import ship
from footfall.sources.shared import checkpointed, release

#: Polygons of a tile that one task merges at a time.
FAN = 32
#: Tiles along a tile's side in which towns that another one hides are left out.
PARTS = 16
#: How far from a town's boundary a centroid still counts as inside, in degrees (fixed value).
TOLERANCE = 0.0001


def _tiles(df: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """``df`` with _box and a row for every tile (_gx, _gy) that the bounds of ``rings`` meet."""
    df = df.where("rings IS NOT NULL AND size(flatten(rings)) > 0").withColumn("_box", polygons.polygon_bounds(F.col("rings")))
    for axis in "xy":
        low, high = bucket(F.col(f"_box.{axis}min") - grow, size), bucket(F.col(f"_box.{axis}max") + grow, size)
        df = df.withColumn(f"_g{axis}", F.explode(F.sequence(low, high)))
    return df


def meeting_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Rows of ``left`` and ``right`` whose bounds overlap, each pair once; ``right`` has its rings as r_rings.

    Both sides are listed under the tiles of their bounds, and a pair counts in
    the tile that holds the lower left corner of what the bounds share.
    """
    l = _tiles(left, size)
    r = _tiles(right, size)
    r = r.select(*[F.col(c).alias(f"r{c}" if c[0] == "_" else f"r_{c}") for c in r.columns])
    low = {a: F.greatest(F.col(f"_box.{a}min"), F.col(f"r_box.{a}min")) for a in "xy"}
    on = (F.col("_gx") == F.col("r_gx")) & (F.col("_gy") == F.col("r_gy"))
    for a in "xy":
        on = on & (low[a] <= F.least(F.col(f"_box.{a}max"), F.col(f"r_box.{a}max"))) & (F.col(f"_g{a}") == bucket(low[a], size))
    return l.join(r, on).drop("_box", "_gx", "_gy", "r_box", "r_gx", "r_gy")


def union_pieces(shapes: DataFrame, size: float) -> DataFrame:
    """gx, gy and rings: the union of all polygons, cut at tiles.

    Polygons are cut by tile, equal pieces become one, and the pieces of a tile
    are merged in a tree of groups of about FAN, a round each, so a tile that
    everything covers is no single task's work. Each round is written.
    """
    ship(shapes.sparkSession)
    x, y = F.col("_gx") * size, F.col("_gy") * size
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    tile = F.array(F.array(corner(x, y), corner(x + size, y), corner(x + size, y + size), corner(x, y + size)))
    inside = (F.col("_box.xmin") >= x) & (F.col("_box.xmax") <= x + size) & (F.col("_box.ymin") >= y) & (F.col("_box.ymax") <= y + size)
    listed = _tiles(shapes.select("rings"), size)
    whole = listed.where(inside).select("_gx", "_gy", "rings")
    cut = listed.where(~inside).select("_gx", "_gy", polygons.overlay_rings(F.col("rings"), tile).alias("rings"))
    pieces = whole.unionByName(cut).where("size(rings) > 0").select(F.col("_gx").alias("gx"), F.col("_gy").alias("gy"), polygons.flat(F.col("rings")).alias("rings"))
    pieces = checkpointed(pieces.distinct())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        layers = polygons.overlay([polygons.decode(r) for r in group["rings"]], "union")
        return pd.DataFrame({"gx": group["gx"][:1], "gy": group["gy"][:1], "rings": [polygons.encode(polygons.rings_of(layers))]})

    last = False
    while not last:
        sizes = pieces.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"))
        last = not (most := sizes.agg(F.max("n")).first()[0]) or most <= FAN
        slots = F.ceil(F.col("n") / FAN).cast("long")
        grouped = pieces.join(sizes, ["gx", "gy"]).withColumn("slot", F.pmod(F.xxhash64("rings"), slots)).groupBy("gx", "gy", "slot")
        merged = checkpointed(grouped.applyInPandas(merge, "gx long, gy long, rings array<array<double>>"))
        release(pieces)
        pieces = merged
    return pieces.select("gx", "gy", polygons.shaped(F.col("rings")).alias("rings"))


def union_area(pieces: DataFrame) -> DataFrame:
    """Area of a union in one row, from its pieces."""
    return pieces.agg(F.coalesce(F.sum(polygons.polygon_area(F.col("rings"))), F.lit(0.0)).alias("area"))


def clip(shapes: DataFrame, pieces: DataFrame, size: float) -> DataFrame:
    """Shapes (id, rings) that meet an area, with inside_area, area, clip_ratio, and a place (lon, lat) inside both.

    ``pieces`` (rings) make up the area and don't overlap, as those of
    :func:`union_pieces`. Only shapes that share some area are left; a shape
    without area of its own has the ratio 1. The place lies in the largest
    shared piece.
    """
    ship(shapes.sparkSession)
    pairs = meeting_pairs(shapes.select("id", "rings"), pieces.select("rings"), size)
    shared = pairs.select("id", polygons.overlay_facts(F.col("rings"), F.col("r_rings")).alias("f")).where("f.area > 0")
    sums = shared.groupBy("id").agg(F.sum("f.area").alias("inside_area"), F.max_by("f", "f.area").alias("f"))
    own = shapes.select("id", polygons.polygon_area(F.col("rings")).alias("area"))
    ratio = F.coalesce(F.try_divide("inside_area", "area"), F.lit(1.0))
    return sums.join(own, "id").select("id", "inside_area", "area", ratio.alias("clip_ratio"), F.col("f.x").alias("lon"), F.col("f.y").alias("lat"))


def first_towns(towns: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """``towns`` (ord, name, rings as r_rings) by small tile (_gx, _gy, of side ``size`` / PARTS), but for those that can't be first at any of its places.

    Where a town covers a whole tile, those of a larger ord are left out there;
    of a place in the tile, the first town and whether there is one stay.
    """
    own = towns.select("ord", "name", "rings")
    side = size / PARTS
    x, y, rim = F.col("_gx") * side, F.col("_gy") * side, side * 1e-6
    apart = lambda s: (
        (F.greatest(s["p"]["x"], s["q"]["x"]) < x - rim) | (F.least(s["p"]["x"], s["q"]["x"]) > x + side + rim)
        | (F.greatest(s["p"]["y"], s["q"]["y"]) < y - rim) | (F.least(s["p"]["y"], s["q"]["y"]) > y + side + rim)
    )
    covers = F.forall(polygons.polygon_sides(F.col("rings")), apart) & polygons.in_polygon(x + side / 2, y + side / 2, F.col("rings"))
    listed = checkpointed(_tiles(own, side, grow).select("ord", "_gx", "_gy", covers.alias("_whole")))
    hiding = listed.where("_whole").groupBy("_gx", "_gy").agg(F.min("ord").alias("_first"))
    seen = listed.join(hiding, ["_gx", "_gy"], "left").where("_first IS NULL OR ord <= _first").select("ord", "_gx", "_gy")
    return checkpointed(seen.join(own.withColumnRenamed("rings", "r_rings"), "ord"))


def assign_towns(shapes: DataFrame, towns: DataFrame, size: float) -> DataFrame:
    """id and town of shapes (id, rings): the first town (ord, name, rings) that holds the centroid, else the one that shares most.

    A centroid within TOLERANCE of a town counts as inside; shapes that share
    no area with any town are left out. Equal shares go to the smaller ord.
    """
    ship(shapes.sparkSession)
    x, y = polygons.polygon_centroid(F.col("rings"))
    centred = shapes.where("size(flatten(rings)) > 0").select("id", "rings", x.alias("_x"), y.alias("_y"))
    close = F.array_min(F.transform("r_rings", lambda r: geo.distance_to_ring(F.col("_x"), F.col("_y"), r))) < TOLERANCE
    side = size / PARTS
    at = centred.select("id", "_x", "_y", bucket(F.col("_x"), side).alias("_gx"), bucket(F.col("_y"), side).alias("_gy"))
    placed = at.join(first_towns(towns, size, TOLERANCE), ["_gx", "_gy"])
    placed = placed.where(polygons.in_polygon(F.col("_x"), F.col("_y"), F.col("r_rings")) | close)
    first = checkpointed(placed.groupBy("id").agg(F.min(F.struct("ord", "name")).alias("t")).select("id", F.col("t.name").alias("town")))
    rest = centred.join(first, "id", "left_anti").select("id", "rings")
    pairs = meeting_pairs(rest, towns.select("ord", "name", "rings"), size)
    shares = pairs.select("id", "r_ord", "r_name", polygons.overlay_area(F.col("rings"), F.col("r_rings")).alias("a")).where("a > 0")
    most = shares.groupBy("id").agg(F.max(F.struct("a", (-F.col("r_ord")).alias("o"), F.col("r_name").alias("name"))).alias("t"))
    return first.unionByName(most.select("id", F.col("t.name").alias("town")))


def study_block_groups(block_groups: DataFrame, towns: DataFrame, size: float = 0.05) -> DataFrame:
    """Block groups (geoid, rings) of the study area, clipped to it: geoid, city, lat, lon, clip_ratio, area and inside_area.

    The area is the union of all towns (ord, name, rings), so towns that
    overlap count once.
    """
    shapes = block_groups.select(F.col("geoid").alias("id"), "rings")
    clipped = clip(shapes, union_pieces(towns, size), size)
    return clipped.join(assign_towns(shapes, towns, size), "id").select(
        F.col("id").alias("geoid"), F.col("town").alias("city"), "lat", "lon", "clip_ratio", "area", "inside_area"
    )
