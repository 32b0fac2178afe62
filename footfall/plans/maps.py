"""Queries of the map operators: hexagon cells and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import geo, hexgrid, polygons
from footfall.functions.text import half_up
from footfall.operators import access, closure, clusters, demand, reports, shapes, spatial
from footfall.plans import tables as T
from footfall.plans.queries import CLOSURE, FAC, PTS, RANK, hav, query
from footfall.ship import ship
from footfall.sources.shared import checkpointed


@query()
def hexagon_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households by H3 cell and city."""
    return demand.cells(demand.allocate(T.buildings(spark, sf_dir), T.block_groups(spark, sf_dir)))


@query(
    """SELECT vec_id, true AS inside, true AS centre_inside, true AS same_cell, true AS closed, 9::BIGINT AS resolution
  FROM embeddings WHERE isfinite(embedding[1]) AND isfinite(embedding[2])"""
)
def hexagon_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place's cell: its ring holds the place and the cell's centre, whose cell it is."""
    ship(spark)
    own = T.points(spark, sf_dir).where("lat between -90 and 90 and abs(lon) <= 720")
    own = own.select("vec_id", "lat", "lon", hexgrid.cell_of(F.col("lat"), F.col("lon"), 9).alias("h3"))
    cells = own.select("h3").distinct().select("h3", hexgrid.cell_ring(F.col("h3")).alias("ring"), hexgrid.cell_centre(F.col("h3")).alias("centre"))
    cells = cells.withColumn("again", hexgrid.cell_of(F.col("centre.lat"), F.col("centre.lon"), 9))
    ring = F.slice("ring", F.lit(1), F.size("ring") - 1)
    return own.join(cells, "h3").select(
        "vec_id",
        geo.covers(F.col("lon"), F.col("lat"), ring).alias("inside"),
        geo.covers(F.col("centre.lon"), F.col("centre.lat"), ring).alias("centre_inside"),
        (F.col("again") == F.col("h3")).alias("same_cell"),
        (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"),
        F.shiftright(hexgrid.to_number(F.col("h3")), 52).bitwiseAND(15).alias("resolution"),
    )


#: Boxes around places, as the shapes of towns (label 0) and block groups (all others).
BOXES = f"""{PTS}, boxes AS (SELECT vec_id, label, lon - (0.01::DOUBLE + (vec_id % 7) * 0.01::DOUBLE) AS x0, lon + (0.01::DOUBLE + (vec_id % 7) * 0.01::DOUBLE) AS x1,
  lat - (0.01::DOUBLE + (vec_id % 5) * 0.008::DOUBLE) AS y0, lat + (0.01::DOUBLE + (vec_id % 5) * 0.008::DOUBLE) AS y1 FROM pts),
 towns AS (SELECT * FROM boxes WHERE label = 0), groups AS (SELECT * FROM boxes WHERE label <> 0)"""
#: The towns' union as the elementary boxes between all their edges that some town covers.
COVERED = """xs AS (SELECT v AS x0, lead(v) OVER (ORDER BY v) AS x1 FROM (SELECT x0 AS v FROM towns UNION SELECT x1 FROM towns)),
 ys AS (SELECT v AS y0, lead(v) OVER (ORDER BY v) AS y1 FROM (SELECT y0 AS v FROM towns UNION SELECT y1 FROM towns)),
 covered AS (SELECT x0, x1, y0, y1 FROM xs, ys WHERE EXISTS (SELECT 1 FROM towns t WHERE t.x0 <= xs.x0 AND xs.x1 <= t.x1 AND t.y0 <= ys.y0 AND ys.y1 <= t.y1))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name and rings of boxes around all places."""
    w, h = F.lit(0.01) + F.col("vec_id") % 7 * 0.01, F.lit(0.01) + F.col("vec_id") % 5 * 0.008
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, x1, y0, y1 = F.col("lon") - w, F.col("lon") + w, F.col("lat") - h, F.col("lat") + h
    box = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
    own = T.points(spark, sf_dir).where("lon IS NOT NULL AND lat IS NOT NULL")
    return own.select(F.col("vec_id").alias("ord"), "label", F.concat(F.lit("Town "), F.col("vec_id").cast("string")).alias("name"), F.array(box).alias("rings"))


@query(f"WITH {BOXES}, {COVERED} SELECT floor(sum((x1 - x0) * (y1 - y0)) * 1e9 + 0.5) / 1e9 AS area FROM covered")
def union_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of all towns; what several cover counts once."""
    towns = _boxes(spark, sf_dir).where("label = 0")
    return shapes.union_area(shapes.union_pieces(towns, 0.1)).select(half_up(F.col("area"), 9).alias("area"))


@query(
    f"""WITH {BOXES}, {COVERED}, shared AS (SELECT g.vec_id, least(g.x1, c.x1) - greatest(g.x0, c.x0) AS w, least(g.y1, c.y1) - greatest(g.y0, c.y0) AS h,
   (g.x1 - g.x0) * (g.y1 - g.y0) AS area FROM groups g JOIN covered c ON g.x0 < c.x1 AND c.x0 < g.x1 AND g.y0 < c.y1 AND c.y0 < g.y1),
 own AS (SELECT vec_id, floor(sum(w * h) / any_value(area) * 1e6 + 0.5) / 1e6 AS clip_ratio FROM shared GROUP BY vec_id),
 inside AS (SELECT g.vec_id, min(t.vec_id) AS town FROM groups g JOIN towns t
   ON sqrt(pow(greatest(t.x0 - (g.x0 + g.x1) / 2, 0, (g.x0 + g.x1) / 2 - t.x1), 2) + pow(greatest(t.y0 - (g.y0 + g.y1) / 2, 0, (g.y0 + g.y1) / 2 - t.y1), 2)) < 0.0001 GROUP BY ALL),
 most AS (SELECT g.vec_id, arg_min(t.vec_id, struct_pack(a := -(least(g.x1, t.x1) - greatest(g.x0, t.x0)) * (least(g.y1, t.y1) - greatest(g.y0, t.y0)), v := t.vec_id)) AS town
   FROM groups g JOIN towns t ON g.x0 < t.x1 AND t.x0 < g.x1 AND g.y0 < t.y1 AND t.y0 < g.y1 GROUP BY ALL)
 SELECT o.vec_id AS geoid, 'Town ' || coalesce(i.town, m.town) AS city, clip_ratio, true AS labelled
 FROM own o LEFT JOIN inside i USING (vec_id) LEFT JOIN most m USING (vec_id)"""
)
def clipped_block_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block groups clipped to the towns' union, their towns, and whether the label's place is inside a town and the block group."""
    every = _boxes(spark, sf_dir)
    towns = every.where("label = 0").select("ord", "name", "rings")
    groups = every.where("label <> 0").select(F.col("ord").alias("geoid"), "rings")
    found = checkpointed(shapes.study_block_groups(groups, towns, 0.1).join(groups, "geoid"))
    # a town that another one hides says nothing about being inside one
    hiding = shapes.first_towns(towns, 0.1).select(F.col("r_rings").alias("rings"), "_gx", "_gy")
    side = 0.1 / shapes.PARTS
    placed = found.select("geoid", "lon", "lat", spatial.bucket(F.col("lon"), side).alias("_gx"), spatial.bucket(F.col("lat"), side).alias("_gy"))
    in_town = placed.join(hiding, ["_gx", "_gy"]).where(polygons.in_polygon(F.col("lon"), F.col("lat"), F.col("rings"))).select("geoid").distinct()
    labelled = F.col("_in").isNotNull() & polygons.in_polygon(F.col("lon"), F.col("lat"), F.col("rings"))
    found = found.join(in_town.withColumn("_in", F.lit(1)), "geoid", "left")
    return found.select("geoid", "city", half_up(F.col("clip_ratio"), 6).alias("clip_ratio"), labelled.alias("labelled"))


#: Two parts, one with a square hole: the shape that places are tested against.
HOLED = [
    [(-71.30, 42.20), (-70.90, 42.20), (-70.90, 42.50), (-71.30, 42.50)],
    [(-71.20, 42.30), (-71.20, 42.40), (-71.05, 42.40), (-71.05, 42.30)],
    [(-71.15, 42.60), (-70.80, 42.55), (-71.00, 42.75)],
]


def _side_rows() -> str:
    rows = [f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for r in HOLED for (a, b), (c, d) in zip(r, r[1:] + r[:1])]
    return f"sides(x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


@query(
    f"""WITH {PTS}, {_side_rows()} SELECT vec_id FROM pts, sides GROUP BY vec_id
  HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1"""
)
def places_outside_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a polygon of two parts, those in its hole left out."""
    rings = [[tuple(p) for p in r] for r in HOLED]
    shape = spark.createDataFrame([("holed", rings)], "name string, rings array<array<struct<x double, y double>>>")
    return spatial.points_in_polygons(T.points(spark, sf_dir), shape).select("vec_id")


@query(
    f"""WITH {PTS}, world AS (SELECT floor((lon + 180) / 360 * 1099511627776.0::DOUBLE)::BIGINT AS x,
   floor((0.5::DOUBLE - ln(tan(pi() / 4 + radians(greatest(-85, least(85, lat))) / 2)) / (2 * pi())) * 1099511627776.0::DOUBLE)::BIGINT AS y FROM pts),
 zooms AS (SELECT z AS zoom, 85899345920 // pow(2, z)::BIGINT AS side FROM range(13) AS r(z))
 SELECT zoom::INT AS zoom, floor(x / side)::BIGINT AS cx, floor(y / side)::BIGINT AS cy, count(*) AS points, round(avg(x / 1099511627776.0::DOUBLE) * 360 - 180, 6) AS lon
 FROM world, zooms GROUP BY ALL"""
)
def zoom_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all places at every zoom."""
    found = clusters.cluster_levels(T.points(spark, sf_dir).select("lat", "lon"))
    return found.select("zoom", "cx", "cy", "points", F.round("lon", 6).alias("lon"))


@query(
    f"""WITH {PTS}, {FAC}, asked AS (SELECT vec_id AS point_id, lat, lon, CASE vec_id % 4 WHEN 0 THEN 'Pharmacy' WHEN 1 THEN 'store 4' WHEN 2 THEN 'ORE' ELSE '' || (vec_id % 10) END AS hint
   FROM pts WHERE label <> 0),
 pairs AS (SELECT a.point_id, f.id, f.ord, {hav('a', 'f')} AS m FROM asked a JOIN fac f ON lower(a.hint) = 'pharmacy' OR contains(lower(f.name), lower(a.hint)))
 SELECT point_id, arg_min(id, struct_pack(near := m < 3000, m := m, ord := ord)) AS id, round(arg_min(m, struct_pack(near := m < 3000, m := m, ord := ord)), 3) AS distance_m
 FROM pairs GROUP BY point_id"""
)
def named_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest facility, not too near, whose name holds a hint."""
    hint = F.expr("CASE vec_id % 4 WHEN 0 THEN 'Pharmacy' WHEN 1 THEN 'store 4' WHEN 2 THEN 'ORE' ELSE concat('', vec_id % 10) END")
    asked = T.points(spark, sf_dir).where("label <> 0").select(F.col("vec_id").alias("point_id"), "lat", "lon", hint.alias("hint"))
    return access.nearest_named(asked, T.facilities(spark, sf_dir), 3000.0).select("point_id", "id", F.round("distance_m", 3).alias("distance_m"))


_SHARE = "CASE WHEN {w} = 0 THEN 0 WHEN 100 * {p} / {w} > 0 AND 100 * {p} / {w} < 1 THEN 1 WHEN 100 * {p} / {w} > 99 AND 100 * {p} / {w} < 100 THEN 99 ELSE floor(100 * {p} / {w} + 0.5) END::BIGINT"


@query(
    f"""{CLOSURE}, {RANK}, s AS (SELECT nearest_id AS id, second_id AS alt_id, sum(households) AS h, min(ord) AS first_ FROM flags
   WHERE near_ AND second_m IS NOT NULL GROUP BY ALL),
 m AS (SELECT id, alt_id, min(v) AS m FROM (SELECT *, sum(w) OVER (PARTITION BY id, alt_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS run,
   sum(w) OVER (PARTITION BY id, alt_id) AS total FROM (SELECT nearest_id AS id, second_id AS alt_id, second_m AS v,
   sum(households) AS w FROM flags WHERE near_ AND second_m IS NOT NULL GROUP BY ALL)) WHERE run >= total / 2 GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h DESC, first_) AS place FROM s),
 longest AS (SELECT id, max(m) / 1.34112::DOUBLE / 60 AS minutes FROM top JOIN m USING (id, alt_id) WHERE place <= 3 GROUP BY id),
 p AS (SELECT r.id, r.rank, r.of, coalesce(newly_households, 0) AS n, coalesce(kept_households, 0) AS k, coalesce(affected_households, 0) AS a, l.minutes
   FROM ranks r LEFT JOIN closed c USING (id) LEFT JOIN longest l USING (id))
 SELECT id, {_SHARE.format(p='n', w='a')} AS loss_percent, {_SHARE.format(p='k', w='a')} AS kept_percent, round(CASE WHEN a = 0 THEN 0 ELSE n / a * 100 END, 6)::DOUBLE AS loss_share,
   round(greatest(15, coalesce(minutes, 0)), 6)::DOUBLE AS alternative_ceiling_min, rank, of,
   rank || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
   {_SHARE.format(p='(of - rank)', w='of')} AS worse_than_percent FROM p"""
)
def closure_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the panel says of every facility that can be closed."""
    found = closure.panels(T.access_cells(spark, sf_dir), T.facilities(spark, sf_dir), T.MPS, T.THRESHOLD)
    return found.withColumns({c: F.round(c, 6) for c in ("loss_share", "alternative_ceiling_min")})


@query(
    """WITH w AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'bridge' WHEN l_returnflag = 'A' THEN 'network' ELSE 'landmark' END AS kind, l_extendedprice / 50 AS m,
   l_quantity * 50 AS g, CASE WHEN l_linenumber <> 4 THEN l_extendedprice / 60 END AS r FROM lineitem),
 c AS (SELECT *, kind = 'bridge' AND NOT (m / g BETWEEN 1 / 1.75::DOUBLE AND 1.75) AS bad, CASE WHEN g < 200 THEN m <= 500
   WHEN kind = 'bridge' AND NOT (m / g BETWEEN 1 / 1.75::DOUBLE AND 1.75) THEN false WHEN r IS NOT NULL AND r / g <= 2.0 THEN m <= r * 1.5 ELSE m <= g * 1.75 END AS ok FROM w)
 SELECT kind, count(*) AS walks, count_if(NOT ok)::BIGINT AS flagged, count_if(bad)::BIGINT AS bad_bridges, count_if(r IS NULL)::BIGINT AS reference_missing, bool_and(ok) AS all_pass FROM c GROUP BY kind"""
)
def validated_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample walks held against straight lines and an outside router, summed up by kind."""
    kind = F.when(F.col("l_returnflag") == "R", "bridge").when(F.col("l_returnflag") == "A", "network").otherwise("landmark")
    walks = T.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), kind.alias("kind"), (F.col("l_extendedprice") / 50).alias("modeled_m"), (F.col("l_quantity") * 50).alias("geodesic_m"),
        F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice") / 60).alias("reference_m"), F.lit(1.0).alias("snap_o_m"), F.lit(2.0).alias("snap_d_m"),
    )
    return reports.validation_summary(reports.checked_walks(walks))
