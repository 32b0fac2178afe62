"""Queries of the engine's operators by name, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.constants import LCC
from footfall.functions import geo
from footfall.functions import text as X
from footfall.operators import access, closure, demand, network, reports, roster, spatial
from footfall.plans import tables as T
from footfall.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hav(a: str, b: str) -> str:
    """The great-circle formula of SQL aliases with lat and lon."""
    return (
        f"(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * "
        f"cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


PTS = """pts AS (SELECT vec_id, label, embedding[1]::DOUBLE / 5 + -71.1::DOUBLE AS lon,
  embedding[2]::DOUBLE / 5 + 42.35::DOUBLE AS lat FROM embeddings)"""
FAC = """fac AS (SELECT lpad(vec_id::VARCHAR, 8, '0') AS id, 'Store ' || vec_id AS name, vec_id || ' Main Street' AS address,
  'City ' || (vec_id % 7) AS city, lat, lon, vec_id % 5 <> 0 AS in_study_area, vec_id % 3 <> 0 AS simulatable, vec_id AS ord
  FROM pts WHERE label = 0)"""
CELLS = """cells AS (SELECT vec_id AS ord, vec_id::VARCHAR AS h3, label::VARCHAR AS city,
  (1 + vec_id % 17)::DOUBLE AS households, lat, lon FROM pts WHERE label <> 0)"""
ACC = f"""near AS (SELECT c.ord, f.id, {hav('c', 'f')} AS m FROM cells c CROSS JOIN fac f),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY m, id) AS k FROM near),
  acc AS (SELECT c.*, a.id AS nearest_id, floor(a.m * 10 + 0.5) / 10 AS nearest_m, b.id AS second_id,
          floor(b.m * 10 + 0.5) / 10 AS second_m
          FROM cells c LEFT JOIN ranked a ON a.ord = c.ord AND a.k = 1 LEFT JOIN ranked b ON b.ord = c.ord AND b.k = 2),
  flags AS (SELECT *, coalesce(nearest_m / 1.34112::DOUBLE / 60 <= 15, false) AS near_,
            coalesce(second_m / 1.34112::DOUBLE / 60 <= 15, false) AS still FROM acc)"""
BASE = f"WITH {PTS}, {FAC}, {CELLS}, {ACC}"


@query(f"{BASE} SELECT ord, h3, households, nearest_id, nearest_m, second_id, second_m FROM acc")
def nearest_two_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest and second facility of every cell."""
    return T.access_cells(spark, sf_dir).select("ord", "h3", "households", "nearest_id", "nearest_m", "second_id", "second_m")


@query(
    f"""{BASE} SELECT count(*) AS cells_total, count(nearest_m) AS cells_reachable,
  floor(avg((nearest_m IS NOT NULL)::INT::DOUBLE) * 1000 + 0.5) / 1000 AS reachable_share,
  floor(quantile_cont(nearest_m, 0.5) * 10 + 0.5) / 10 AS median_nearest_m,
  floor(quantile_cont(nearest_m, 0.9) * 10 + 0.5) / 10 AS p90_nearest_m FROM acc"""
)
def access_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.summary(T.access_cells(spark, sf_dir))


def _median(value: str, name: str) -> str:
    return f"""{name} AS (SELECT id, min(v) AS m FROM (
      SELECT id, v, sum(w) OVER (PARTITION BY id ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY id) AS total
      FROM (SELECT nearest_id AS id, {value} AS v, sum(households) AS w FROM flags
            WHERE near_ AND second_m IS NOT NULL GROUP BY ALL)) WHERE run >= total / 2 GROUP BY id)"""


CLOSURE = f"""{BASE}, {_median('second_m - nearest_m', 'mx')}, {_median('nearest_m', 'mb')}, {_median('second_m', 'ma')},
 t AS (SELECT nearest_id AS id, sum(CASE WHEN near_ AND NOT still THEN households ELSE 0 END) AS newly_households,
   sum(CASE WHEN near_ AND still THEN households ELSE 0 END) AS kept_households, sum(households) AS served_households,
   bool_or(near_ AND second_m IS NULL) AS some_unreachable,
   max(second_m - nearest_m) FILTER (WHERE near_ AND second_m IS NOT NULL) AS xm,
   max(second_m) FILTER (WHERE near_ AND second_m IS NOT NULL) AS am FROM flags GROUP BY nearest_id),
 w AS (SELECT nearest_id AS id, nearest_m AS bm FROM (SELECT *, row_number() OVER (PARTITION BY nearest_id
   ORDER BY second_m DESC, ord) AS k FROM flags WHERE near_ AND second_m IS NOT NULL) WHERE k = 1),
 closed AS (SELECT t.id, newly_households, kept_households, newly_households + kept_households AS affected_households,
   served_households, some_unreachable, mx.m AS median_extra, mx.m / 1.34112::DOUBLE / 60 AS median_extra_min,
   mb.m / 1.34112::DOUBLE / 60 AS median_before_min, ma.m / 1.34112::DOUBLE / 60 AS median_after_min,
   xm / 1.34112::DOUBLE / 60 AS max_extra_min, bm / 1.34112::DOUBLE / 60 AS max_before_min,
   am / 1.34112::DOUBLE / 60 AS max_after_min
   FROM t LEFT JOIN mx USING (id) LEFT JOIN mb USING (id) LEFT JOIN ma USING (id) LEFT JOIN w USING (id))"""
RANK = """lost AS (SELECT nearest_id AS id, sum(households) AS h FROM flags WHERE near_ AND NOT still GROUP BY nearest_id),
  ranks AS (SELECT fac.id, coalesce(h, 0)::DOUBLE AS lost_households, row_number() OVER (ORDER BY coalesce(h, 0) DESC, fac.id) AS rank,
  count(*) OVER () AS of FROM fac LEFT JOIN lost USING (id) WHERE in_study_area AND simulatable)"""


@query(f"{CLOSURE} SELECT * FROM closed")
def closure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closing each facility would change, all in one pass."""
    return closure.closure_table(T.access_cells(spark, sf_dir), T.MPS, T.THRESHOLD)


@query(f"{BASE}, {RANK} SELECT * FROM ranks")
def closure_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.closure_ranks(T.access_cells(spark, sf_dir), T.facilities(spark, sf_dir), T.MPS, T.THRESHOLD)


@query(f"{BASE}, {RANK} SELECT id, lost_households, rank, of FROM ranks ORDER BY lost_households > 0 DESC, lost_households DESC, id LIMIT 1")
def example_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.example_closure(T.access_cells(spark, sf_dir), T.facilities(spark, sf_dir), T.MPS, T.THRESHOLD)


@query(f"{BASE} SELECT nearest_id AS id, sum(households) AS served_households FROM acc GROUP BY nearest_id")
def served_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.served_households(T.access_cells(spark, sf_dir))


@query(f"{BASE} SELECT nearest_id AS id, sum(households) AS lost_households FROM flags WHERE near_ AND NOT still GROUP BY nearest_id")
def newly_lost_by_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.newly_lost_by_facility(T.access_cells(spark, sf_dir), T.MPS, T.THRESHOLD)


@query(f"{BASE} SELECT coalesce(sum(households) FILTER (WHERE NOT near_), 0)::DOUBLE AS already_households FROM flags")
def already_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.already_beyond(T.access_cells(spark, sf_dir), T.MPS, T.THRESHOLD)


@query(
    f"""{BASE}, s AS (SELECT nearest_id AS id, second_id AS alt_id, sum(households) AS households, min(ord) AS first_
  FROM flags WHERE near_ AND second_m IS NOT NULL GROUP BY ALL),
 m AS (SELECT id, alt_id, min(v) AS m FROM (SELECT *, sum(w) OVER (PARTITION BY id, alt_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS run,
   sum(w) OVER (PARTITION BY id, alt_id) AS total FROM (SELECT nearest_id AS id, second_id AS alt_id, second_m AS v,
   sum(households) AS w FROM flags WHERE near_ AND second_m IS NOT NULL GROUP BY ALL)) WHERE run >= total / 2 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY households DESC, first_) AS place FROM s)
 SELECT r.id, r.alt_id, fac.name AS alt_name, r.households, m.m / 1.34112::DOUBLE / 60 AS minutes, r.place
 FROM r LEFT JOIN m ON m.id = r.id AND m.alt_id = r.alt_id LEFT JOIN fac ON fac.id = r.alt_id WHERE place <= 3"""
)
def alternatives_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.alternatives(T.access_cells(spark, sf_dir), T.facilities(spark, sf_dir), T.MPS, T.THRESHOLD)


@query(
    f"""{CLOSURE}, {RANK}, one AS (SELECT id FROM ranks WHERE rank = 1)
 SELECT (SELECT coalesce(sum(households) FILTER (WHERE NOT near_), 0)::DOUBLE FROM flags) AS already_households,
   newly_households, kept_households, affected_households, some_unreachable, median_extra, median_extra_min,
   median_before_min, median_after_min, max_extra_min, max_before_min, max_after_min
 FROM closed WHERE id = (SELECT id FROM one)"""
)
def closure_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything one closure changes: that of the facility ranked first."""
    cells, fac = T.access_cells(spark, sf_dir), T.facilities(spark, sf_dir)
    first = closure.closure_ranks(cells, fac, T.MPS, T.THRESHOLD).where("rank = 1").first()
    return closure.impact(cells, fac, first["id"] if first else None, T.MPS, T.THRESHOLD).drop("alternatives")


@query(f"{BASE} SELECT id, name, address, city, ord FROM fac WHERE in_study_area AND contains(lower(name || ' ' || address || ' ' || city), 'city 3') ORDER BY ord LIMIT 10")
def facility_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.search(T.facilities(spark, sf_dir), " City 3 ").select("id", "name", "address", "city", "ord")


@query(
    f"""{BASE}, {RANK}, one AS (SELECT id FROM ranks WHERE rank = 1)
 SELECT h3, CASE WHEN nearest_id = one.id THEN second_id ELSE nearest_id END AS access_id,
  CASE WHEN nearest_id = one.id AND near_ AND NOT still THEN 'Newly lost'
       WHEN CASE WHEN nearest_id = one.id THEN still ELSE near_ END THEN 'Still walkable' ELSE 'Too far' END AS status
 FROM flags CROSS JOIN one"""
)
def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, fac = T.access_cells(spark, sf_dir), T.facilities(spark, sf_dir)
    first = closure.closure_ranks(cells, fac, T.MPS, T.THRESHOLD).where("rank = 1").first()
    return closure.map_cells(cells, first["id"] if first else None, T.MPS, T.THRESHOLD).select("h3", "access_id", "status")


@query(
    f"""WITH {PTS}, {FAC}, {CELLS} SELECT c.ord, f.id, floor({hav('c', 'f')} * 1000 + 0.5) / 1000 AS distance_m
  FROM cells c JOIN fac f ON {hav('c', 'f')} <= 1500"""
)
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities within 1,500 m of each cell, by buckets."""
    right = T.facilities(spark, sf_dir).select("id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    pairs = spatial.within_radius(T.demand_cells(spark, sf_dir), right, 1500.0)
    return pairs.select("ord", "id", X.half_up(F.col("distance_m"), 3).alias("distance_m"))


RING = "[(-71.15, 42.30), (-71.05, 42.30), (-71.05, 42.40), (-71.10, 42.35), (-71.15, 42.40)]"
RINGS = [
    ("concave", [(-71.15, 42.30), (-71.05, 42.30), (-71.05, 42.40), (-71.10, 42.35), (-71.15, 42.40)]),
    ("box", [(-71.12, 42.33), (-71.02, 42.33), (-71.02, 42.45), (-71.12, 42.45)]),
]


def _ring_sql() -> str:
    rows = []
    for name, ring in RINGS:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            rows.append(f"('{name}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return f"sides(name, x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


@query(
    f"""WITH {PTS}, {_ring_sql()} SELECT p.vec_id, s.name FROM pts p CROSS JOIN sides s GROUP BY p.vec_id, s.name
  HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1"""
)
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = spark.createDataFrame([(n, [tuple(p) for p in r]) for n, r in RINGS], "name string, ring array<struct<x double, y double>>")
    return spatial.points_in_polygons(T.points(spark, sf_dir), polygons, inclusive=True).select("vec_id", "name")


@query(
    """WITH w AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
 r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v ROWS UNBOUNDED PRECEDING) AS run,
       sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM w)
 SELECT l_returnflag, l_linestatus, min(v) AS median_price FROM r WHERE run >= total / 2 GROUP BY ALL"""
)
def weighted_median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower weighted median of prices by quantity."""
    return closure.weighted_median_by(
        T.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", "median_price"
    )


BG = """bg AS (SELECT n_nationkey AS geoid, n_regionkey::VARCHAR AS city, n_nationkey * 0.01::DOUBLE + 42.0::DOUBLE AS lat,
  n_nationkey * 0.01::DOUBLE - 71.0::DOUBLE AS lon, count(c_custkey)::DOUBLE AS no_vehicle, n_nationkey + 1.0::DOUBLE AS no_vehicle_moe,
  1.0::DOUBLE - n_nationkey / 50.0::DOUBLE AS clip_ratio
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"""
ALLOC = f"""WITH {BG}, b AS (SELECT s_suppkey::VARCHAR AS id, s_suppkey * 0.0001::DOUBLE + 42.0::DOUBLE AS lat,
   s_suppkey * 0.0001::DOUBLE - 71.0::DOUBLE AS lon,
   CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 80 END * greatest((s_suppkey % 20)::DOUBLE / 3.1::DOUBLE, 1.0::DOUBLE) AS weight,
   s_suppkey % 3 = 0 AS residential, s_nationkey AS geoid, s_nationkey::VARCHAR AS city FROM supplier WHERE s_acctbal < 4000),
 f AS (SELECT *, bool_or(residential) OVER (PARTITION BY geoid) AS any_ FROM b),
 sel AS (SELECT id, lat, lon, weight, residential, geoid, city FROM f WHERE residential OR NOT any_ UNION ALL
   SELECT 'block-group:' || geoid, lat, lon, 1.0, false, geoid, city FROM bg WHERE geoid NOT IN (SELECT geoid FROM f)),
 alloc AS (SELECT sel.*, bg.no_vehicle * weight / sum(weight) OVER (PARTITION BY sel.geoid) AS hh FROM sel LEFT JOIN bg USING (geoid))"""


@query(f"{ALLOC} SELECT id, geoid, city, residential, round(hh, 6) AS hh FROM alloc")
def allocate_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every household on a building of its block group."""
    out = demand.allocate(T.buildings(spark, sf_dir), T.block_groups(spark, sf_dir))
    return out.select("id", "geoid", "city", "residential", F.round("hh", 6).alias("hh"))


@query(f"{ALLOC} SELECT geoid::VARCHAR AS h3, city, round(sum(hh), 6) AS no_vehicle, count(id) AS buildings, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM alloc GROUP BY geoid, city")
def demand_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = demand.allocate(T.buildings(spark, sf_dir), T.block_groups(spark, sf_dir))
    out = demand.cells(placed, F.col("geoid").cast("string"))
    return out.select("h3", "city", F.round("no_vehicle", 6).alias("no_vehicle"), "buildings", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(f"{ALLOC} SELECT round((SELECT sum(hh) FROM alloc), 6) AS allocated, (SELECT sum(no_vehicle) FROM bg) AS expected, true AS conserved")
def mass_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg = T.block_groups(spark, sf_dir)
    out = demand.mass_check(demand.allocate(T.buildings(spark, sf_dir), bg), bg)
    return out.select(F.round("allocated", 6).alias("allocated"), "expected", "conserved")


@query(
    f"""WITH {BG}, r AS (SELECT *, greatest(0, least(1, clip_ratio)) AS c FROM bg)
 SELECT count(*) AS block_groups, count(*) FILTER (WHERE c < 0.99) AS partial_clip_block_groups,
  floor(avg((c < 0.99)::INT::DOUBLE) * 10000 + 0.5) / 10000 AS partial_clip_share,
  floor(sum(CASE WHEN c < 0.99 THEN no_vehicle ELSE 0 END) * 10 + 0.5) / 10 AS no_vehicle_in_partial,
  floor(sum(no_vehicle * (1 - c)) * 10 + 0.5) / 10 AS estimated_no_vehicle_outside_by_area,
  floor(sum(no_vehicle * (1 - c)) / sum(no_vehicle) * 10000 + 0.5) / 10000 AS estimated_outside_share,
  floor(min(c) * 10000 + 0.5) / 10000 AS min_clip_ratio,
  floor(sqrt(sum(no_vehicle_moe * no_vehicle_moe)) * 10 + 0.5) / 10 AS no_vehicle_moe FROM r"""
)
def clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.clip_stats(T.block_groups(spark, sf_dir))


GRAPH = f"""{PTS}, g AS (SELECT a.vec_id AS u, b.vec_id AS v, {hav('a', 'b')} AS m FROM pts a JOIN pts b ON a.vec_id <> b.vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY m, v) AS k FROM g),
 e AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(floor(m * 10 + 0.5) / 10) AS metres FROM k WHERE k <= 3
       GROUP BY ALL HAVING min(floor(m * 10 + 0.5) / 10) > 0),
 d AS (SELECT a AS src, b AS dst, metres FROM e UNION ALL SELECT b, a, metres FROM e)"""


@query(f"WITH {GRAPH} SELECT a, b, metres FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges with their least length."""
    return T.graph(spark, sf_dir)[1]


@query(
    f"""WITH RECURSIVE {GRAPH}, reach(n, c) AS (SELECT vec_id, vec_id FROM pts UNION SELECT d.dst, reach.c FROM reach JOIN d ON d.src = reach.n)
 SELECT n AS node, min(c) AS component FROM reach GROUP BY n"""
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = T.graph(spark, sf_dir)
    return network.components(nodes, edges)


@query(
    f"""WITH RECURSIVE {GRAPH}, reach(n, c) AS (SELECT vec_id, vec_id FROM pts UNION SELECT d.dst, reach.c FROM reach JOIN d ON d.src = reach.n),
 labels AS (SELECT n, min(c) AS c FROM reach GROUP BY n), sizes AS (SELECT c, count(*) AS k FROM labels GROUP BY c)
 SELECT sum(k)::BIGINT AS nodes, (SELECT count(*) FROM e) AS edges, count(*) AS components, max(k) AS largest_nodes,
   max(k) / sum(k) AS largest_share, max(k) / sum(k) >= 0.85 AS dominant FROM sizes"""
)
def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, components and gate of the graph."""
    return network.graph_report(*T.graph(spark, sf_dir))


@query(
    f"""WITH {PTS}, {FAC} SELECT count(*) AS facilities, count_if(in_study_area)::BIGINT AS in_area,
   count_if(in_study_area AND simulatable)::BIGINT AS can_close FROM fac"""
)
def facility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.facility_counts(T.facilities(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {GRAPH}, r(n, m) USING KEY (n) AS (SELECT min(vec_id), 0.0::DOUBLE FROM pts UNION
   SELECT d.dst, min(r.m + d.metres) FROM r JOIN d ON d.src = r.n LEFT JOIN recurring.r AS x ON x.n = d.dst
   WHERE x.m IS NULL OR r.m + d.metres < x.m GROUP BY d.dst)
 SELECT n AS node, round(m, 3) AS metres FROM r"""
)
def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks from the first node to all others."""
    nodes, edges = T.graph(spark, sf_dir)
    start = nodes.agg(F.min("node")).first()[0]
    return network.distances_from(start, edges, nodes).select("node", F.round("metres", 3).alias("metres"))


@query(
    f"""WITH RECURSIVE {GRAPH}, r(n, s, m) USING KEY (n, s) AS (SELECT vec_id, vec_id, 0.0::DOUBLE FROM pts WHERE label = 0 UNION
   SELECT d.dst, r.s, min(r.m + d.metres) FROM r JOIN d ON d.src = r.n LEFT JOIN recurring.r AS x ON x.n = d.dst AND x.s = r.s
   WHERE x.m IS NULL OR r.m + d.metres < x.m GROUP BY d.dst, r.s)
 SELECT n AS node, s AS seed, round(m, 3) AS metres, k AS place
 FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY m, s) AS k FROM r) WHERE k <= 2"""
)
def graph_two_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest facilities of every node over the network."""
    nodes, edges = T.graph(spark, sf_dir)
    seeds = T.points(spark, sf_dir).where("label = 0").select(F.col("vec_id").alias("node"), F.col("vec_id").alias("seed"), F.lit(0.0).alias("metres"))
    return network.nearest_labels(seeds, edges, keep=2, nodes=nodes).select("node", "seed", F.round("metres", 3).alias("metres"), "place")


@query(
    f"""WITH {PTS}, {FAC}, {CELLS}, near AS (SELECT c.ord AS point_id, f.ord AS node, {hav('c', 'f')} AS m,
   (c.lat - f.lat) * (c.lat - f.lat) + (c.lon - f.lon) * (c.lon - f.lon) AS d FROM cells c JOIN fac f ON {hav('c', 'f')} <= 2000)
 SELECT point_id, node, floor(m * 1000 + 0.5) / 1000 AS snap_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, node) AS k FROM near) WHERE k = 1"""
)
def snap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.facilities(spark, sf_dir).select(F.col("ord").alias("node"), "lat", "lon")
    cells = T.demand_cells(spark, sf_dir).select(F.col("ord").alias("point_id"), "lat", "lon")
    return network.snap(cells, nodes, 2000.0).select("point_id", "node", X.half_up(F.col("snap_m"), 3).alias("snap_m"))


@query("SELECT event_type, (props->>'$.k')::INT AS k, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL")
def parsed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column, grouped."""
    e = T.table(spark, sf_dir, "events").select("event_type", "value", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), X.half_up(F.sum("value"), 2).alias("total"))


@query(
    """WITH k AS (SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS key FROM customer),
 d AS (SELECT *, regexp_replace(key, '^[A-Z]+', '') AS digits FROM k)
 SELECT c_custkey, unnest(list_distinct([key, digits, 'DS' || digits])) AS license_key FROM d"""
)
def license_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a licence number."""
    return T.table(spark, sf_dir, "customer").select("c_custkey", F.explode(X.license_keys(F.col("c_name"))).alias("license_key"))


@query("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey, min_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def first_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return roster.first_by(o, ["o_custkey"], F.col("o_orderkey"))


@query("""WITH pts AS (SELECT vec_id, embedding[1]::DOUBLE / 5 + -71.1::DOUBLE AS lon, embedding[2]::DOUBLE / 5 + 42.35::DOUBLE AS lat FROM embeddings)
 SELECT vec_id FROM pts WHERE lon BETWEEN -71.12 AND -71.05 AND lat BETWEEN 42.3 AND 42.4""")
def bbox_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.points(spark, sf_dir)
    return p.where(spatial.in_bbox(F.col("lon"), F.col("lat"), (-71.12, 42.3, -71.05, 42.4))).select("vec_id")


@query("SELECT p_partkey FROM part WHERE p_size + 5 >= 10 AND p_size <= 20 AND p_retailprice + 50 >= 950 AND p_retailprice <= 1000")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    hit = spatial.overlaps_bbox(F.col("p_size"), F.col("p_retailprice"), F.col("p_size") + 5, F.col("p_retailprice") + 50, (10, 950, 20, 1000))
    return p.where(hit).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%red%'")
def any_part_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").where(X.contains_any(F.col("p_name"), ["ring", "bolt", "red"])).select("p_partkey", "p_name")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity,
  CASE WHEN l_quantity * 50 < 200 THEN l_extendedprice / 50 <= 500
       WHEN l_extendedprice / 50 / (l_quantity * 50) NOT BETWEEN 1 / 1.75 AND 1.75 AND l_returnflag = 'R' THEN false
       WHEN l_extendedprice / 60 / (l_quantity * 50) <= 2.0 THEN l_extendedprice / 50 <= l_extendedprice / 60 * 1.5
       ELSE l_extendedprice / 50 <= l_quantity * 50 * 1.75 END AS ok FROM lineitem"""
)
def walk_pairs_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credibility rule over modelled, geodesic and reference walks."""
    l = T.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "bridge").otherwise("landmark")
    ok = access.pair_ok(F.col("l_extendedprice") / 50, F.col("l_quantity") * 50, F.col("l_extendedprice") / 60, kind)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", ok.alias("ok"))


@query(
    """SELECT c_custkey, CASE WHEN (c_custkey % 100) BETWEEN 11 AND 13 THEN c_custkey || 'th' WHEN c_custkey % 10 = 1 THEN c_custkey || 'st'
  WHEN c_custkey % 10 = 2 THEN c_custkey || 'nd' WHEN c_custkey % 10 = 3 THEN c_custkey || 'rd' ELSE c_custkey || 'th' END AS nth,
  CASE WHEN c_custkey % 1000 + 0.25 < 10 THEN 1 WHEN c_custkey % 1000 + 0.25 > 990 THEN 99
  ELSE (c_custkey % 1000 + 5) // 10 END::BIGINT AS share,
  lpad(substr(c_custkey::VARCHAR, 1, 5), 5, '0') AS zip FROM customer"""
)
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        X.ordinal(F.col("c_custkey")).alias("nth"),
        X.share_percent(F.col("c_custkey") % 1000 + F.lit(0.25), F.lit(1000)).alias("share"),
        X.zip5(F.col("c_custkey")).alias("zip"),
    )


@query(
    """WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]{4,}'), lambda x: x NOT IN ('the', 'and'))) AS ts FROM part)
 SELECT token, count(*) AS n FROM (SELECT unnest(ts) AS token FROM t) GROUP BY token"""
)
def name_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select(F.explode(X.name_tokens(F.col("p_name"))).alias("token"))
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT s_nationkey, floor(sqrt(sum(s_acctbal * s_acctbal)) * 100 + 0.5) / 100 AS rss, count(*) FILTER (WHERE s_acctbal <= 0) AS n_missing,
  floor(avg((s_acctbal > 0)::INT::DOUBLE) * 10000 + 0.5) / 10000 AS share FROM supplier GROUP BY s_nationkey"""
)
def grouped_error_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of error, missing values and shares by group."""
    return reports.error_margins(T.table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal")


@query(f"WITH {PTS} SELECT vec_id, floor({hav('a', 'b')} * 1000 + 0.5) / 1000 AS metres FROM pts b CROSS JOIN (SELECT 42.3604::DOUBLE AS lat, -71.0578::DOUBLE AS lon) a")
def haversine_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.haversine_m(F.lit(42.3604), F.lit(-71.0578), F.col("lat"), F.col("lon"))
    return T.points(spark, sf_dir).select("vec_id", X.half_up(d, 3).alias("metres"))


def _lcc_sql() -> str:
    """Forward conic projection of pts in closed form."""
    m = lambda p: f"cos(radians({p})) / sqrt(1 - e * e * pow(sin(radians({p})), 2))"
    t = lambda p: f"tan(pi() / 4 - radians({p}) / 2) / pow((1 - e * sin(radians({p}))) / (1 + e * sin(radians({p}))), e / 2)"
    k = {name: f"{value!r}::DOUBLE" for name, value in LCC.items()}
    return f"""f AS (SELECT 1 / {k['inverse_flattening']} AS f), e AS (SELECT sqrt(2 * f - f * f) AS e FROM f),
 n AS (SELECT e, (ln({m(k['lat1'])}) - ln({m(k['lat2'])})) / (ln({t(k['lat1'])}) - ln({t(k['lat2'])})) AS n FROM e),
 g AS (SELECT e, n, {k['a']} * ({m(k['lat1'])}) / (n * pow({t(k['lat1'])}, n)) AS g FROM n),
 placed AS (SELECT vec_id, lat, lon, g * pow({t('lat')}, n) AS rho, g * pow({t(k['lat0'])}, n) AS rho0, n * (radians(lon) - radians({k['lon0']})) AS turn FROM pts, g)
 SELECT vec_id, round(rho * sin(turn) + {k['x0']}, 3) AS x, round(rho0 - rho * cos(turn) + {k['y0']}, 3) AS y, round(lat, 9) AS lat, round(lon, 9) AS lon FROM placed"""


@query(f"WITH {PTS}, {_lcc_sql()}")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State-plane metres of every place and the way back."""
    x, y = geo.project(F.col("lat"), F.col("lon"))
    p = T.points(spark, sf_dir).select("vec_id", "lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = geo.unproject(F.col("x"), F.col("y"))
    return p.select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query()
def artifact_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published JSON document."""
    fac = T.facilities(spark, sf_dir).select(
        "*",
        F.lit("board").alias("confidence"),
        access.publish_reason(F.col("in_study_area"), F.col("simulatable"), F.lit(None).cast("string")).alias("exclude_reason"),
    )
    return sinks.artifact(T.access_cells(spark, sf_dir), fac, {"threshold_minutes": 15})


def _licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as licences: three names, four statuses, streets, a tenth without an NPI."""
    o = T.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))
    return o.select(
        k.alias("ord"),
        k.cast("string").alias("license"),
        pick(STATUSES, k % 4).alias("license_status"),
        pick(NAMES, k % 5).alias("name"),
        F.when(k % 10 > 0, F.lpad(F.col("o_custkey").cast("string"), 10, "1")).alias("npi"),
        pick(STREETS, k % 6).alias("address"),
        pick(TOWNS, k % 3).alias("city"),
        F.lit("MA").alias("state"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Issue Date"),
        pick(CODES, k % 4).alias("taxonomy_codes"),
    )


STATUSES = ["Current", "Expired", "Probation", "Non-Disciplinary Condition"]
NAMES = ["CVS Pharmacy", "Mail-Order Meds", "Omnicare of Town", "Star Market", "Corner Drug"]
STREETS = ["90 River Street", "1329 Hyde Park Ave", "2275 Washington Street", "12 Main St Suite 4", "416 Warren St", "7 Elm St Room 2"]
TOWNS = ["Mattapan", "Roxbury", "Boston"]
CODES = ["3336C0003X", "3336L0003X, 3336C0003X", "3336L0003X", ""]
_L = f"""WITH l AS (SELECT o_orderkey AS ord, o_orderkey::VARCHAR AS license, {STATUSES}[(o_orderkey % 4 + 1)::INT] AS license_status,
  {NAMES}[(o_orderkey % 5 + 1)::INT] AS name, CASE WHEN o_orderkey % 10 > 0 THEN lpad(o_custkey::VARCHAR, 10, '1') END AS npi,
  {STREETS}[(o_orderkey % 6 + 1)::INT] AS address, {TOWNS}[(o_orderkey % 3 + 1)::INT] AS city, o_orderdate AS issued,
  {CODES}[(o_orderkey % 4 + 1)::INT] AS codes FROM orders) """


@query(
    """WITH d AS (SELECT c_name AS license, right(c_name, 9) AS digits FROM customer),
 s AS (SELECT s_suppkey, s_name, right(s_name, 9) AS digits FROM supplier)
 SELECT license, s_suppkey::VARCHAR AS npi, coalesce(s_name, 'x') AS name FROM d LEFT JOIN s USING (digits)"""
)
def license_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as licences, matched to suppliers as registry rows under any spelling of their numbers."""
    registry = T.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("license"), F.col("s_suppkey").alias("npi"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord")
    )
    board = T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("license"), F.lit("x").alias("name"))
    return roster.match_registry(board, registry).select("license", "npi", "name")


@query(
    _L
    + """SELECT license, CASE WHEN npi IS NOT NULL AND k > 1 THEN first_ END AS duplicate_of FROM (SELECT *, row_number() OVER w AS k,
  first_value(license) OVER w AS first_ FROM l WINDOW w AS (PARTITION BY npi, name ORDER BY issued DESC NULLS LAST, ord))"""
)
def newest_of_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest licence of a storefront stands for the others."""
    return roster.mark_duplicates(_licences(spark, sf_dir)).select("license", "duplicate_of")


@query(_L + "SELECT license_status, name, count(*) AS n FROM l WHERE license_status <> 'Expired' AND name <> 'Mail-Order Meds' GROUP BY ALL")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.active(_licences(spark, sf_dir)).groupBy("license_status", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    _L
    + """SELECT license, address, city FROM l WHERE starts_with(address, '1329') OR (starts_with(address, '90 R') AND city = 'Mattapan')
  OR ((starts_with(address, '2275') OR starts_with(address, '416')) AND city = 'Roxbury')"""
)
def rule_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences at addresses known to have closed."""
    return roster.known_closed(_licences(spark, sf_dir)).select("license", "address", "city")


@query(
    _L
    + """SELECT license, CASE WHEN codes LIKE '%3336C0003X%' THEN 'high' WHEN city = 'Boston' THEN 'medium' ELSE 'board' END AS tier,
  name <> 'Omnicare of Town' AND codes <> '3336L0003X' AS walk_in,
  CASE WHEN name = 'Omnicare of Town' THEN 'Non-storefront pharmacy service' WHEN codes = '3336L0003X' THEN 'Not a public walk-in storefront' END AS reason
  FROM (SELECT * REPLACE (CASE WHEN codes LIKE '%, %' AND name NOT IN ('CVS Pharmacy', 'Star Market', 'Omnicare of Town')
    AND (address LIKE '%Suite%' OR address LIKE '%Room%') THEN '3336L0003X' ELSE codes END AS codes) FROM l
    WHERE NOT (codes LIKE '%, %' AND (address LIKE '%Suite%' OR address LIKE '%Room%')))"""
)
def case_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, walk-in storefronts and the reason of those that are none."""
    l = _licences(spark, sf_dir)
    l = l.where(~(F.contains("taxonomy_codes", F.lit(", ")) & F.col("address").rlike("Suite|Room")))
    tier = roster.confidence(F.col("taxonomy_codes"), F.when(F.col("city") == "Boston", "place"))
    none = F.lit(None).cast("string")
    inside = roster.walk_in(none, F.col("name"), F.col("taxonomy_codes"), F.col("address"))
    return l.select("license", tier.alias("tier"), inside.alias("walk_in"), roster.walk_in_reason(inside, none, F.col("name")).alias("reason"))


@query(
    _L
    + """SELECT license, name IN ('CVS Pharmacy', 'Star Market') AS walk_in FROM l
  WHERE codes LIKE '%, %' AND (address LIKE '%Suite%' OR address LIKE '%Room%')"""
)
def back_office_storefronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office codes in a room or suite are no storefront, but for chains."""
    l = _licences(spark, sf_dir).where(F.contains("taxonomy_codes", F.lit(", ")) & F.col("address").rlike("Suite|Room"))
    inside = roster.walk_in(F.lit(None).cast("string"), F.col("name"), F.col("taxonomy_codes"), F.col("address"))
    return l.select("license", inside.alias("walk_in"))


@query(
    _L
    + """SELECT license, regexp_extract(address, '^[0-9]+') AS number, address || ', ' || city || ' MA ' || lpad(substr(license, 1, 5), 5, '0') AS line,
  address || ', ' || city AS label, name IN ('CVS Pharmacy') AS flag, city AS town,
  array_to_string(list_sort(list_filter(string_split(replace(codes, ' ', ''), ','), lambda c: c <> '')), ' ') AS code_list,
  CASE WHEN npi IS NOT NULL THEN npi || '|' || replace(lower(name), '-', ' ') END AS identity,
  '&lt;b&gt;' || name || '&lt;/b&gt;' AS html, license::DOUBLE AS number_value FROM l"""
)
def roster_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text functions of the roster, a column each."""
    col = F.col
    return _licences(spark, sf_dir).select(
        "license",
        X.street_number(col("address")).alias("number"),
        X.address_line(col("address"), col("city"), col("license")).alias("line"),
        X.place_label(col("address"), col("city")).alias("label"),
        X.as_bool(F.when(col("name") == "CVS Pharmacy", " Yes ").otherwise("no")).alias("flag"),
        X.town_name(F.concat(col("city"), F.lit(" Town"))).alias("town"),
        F.array_join(F.array_sort(X.code_set(col("taxonomy_codes"))), " ").alias("code_list"),
        X.storefront_identity(col("npi"), col("name")).alias("identity"),
        X.escape_html(F.concat(F.lit("<b>"), col("name"), F.lit("</b>"))).alias("html"),
        X.number_or_null(col("license")).alias("number_value"),
    )


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 4000)")
def missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block groups without a building."""
    return T.table(spark, sf_dir, "nation").join(
        T.buildings(spark, sf_dir), F.col("n_nationkey") == F.col("geoid"), "left_anti"
    ).select("n_nationkey")
