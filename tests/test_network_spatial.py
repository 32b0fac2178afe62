import random
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from footfall.functions import geo
from footfall.functions import text as X
from footfall.operators import access, network, spatial


def hav(lat1, lon1, lat2, lon2):
    a = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * asin(sqrt(a))


CONNECTORS = "array<struct<connector_id string, at double>>"


def segments(spark, rows):
    return spark.createDataFrame(rows, f"ord long, id string, name string, subtype string, class string, wkt string, connectors {CONNECTORS}")


def test_shared_connectors_join(spark):
    rows = [
        (0, "s1", None, "road", "footway", "LINESTRING (-71.10 42.35, -71.09 42.35)", [("A", 0.0), ("B", 1.0)]),
        (1, "s2", None, "road", "footway", "LINESTRING (-71.09 42.35, -71.08 42.35)", [("B", 0.0), ("C", 1.0)]),
        (2, "s3", None, "road", "footway", "POINT (1 1)", [("B", 0.0), ("Z", 1.0)]),
    ]
    nodes, edges = network.build_edges(segments(spark, rows))
    assert {r["node"] for r in nodes.collect()} == {"A", "B", "C"}
    got = {(r["a"], r["b"]): r["metres"] for r in edges.collect()}
    assert set(got) == {("A", "B"), ("B", "C")}
    assert got["A", "B"] == pytest.approx(hav(42.35, -71.10, 42.35, -71.09), abs=1e-6)


def test_touching_lines_do_not_join(spark):
    line = "LINESTRING (-71.10 42.35, -71.09 42.35)"
    rows = [(0, "x", None, "road", "footway", line, [("A", 0.0), ("B", 1.0)]), (1, "y", None, "road", "footway", line, [("D", 0.0), ("E", 1.0)])]
    nodes, edges = network.build_edges(segments(spark, rows))
    assert nodes.count() == 4 and edges.count() == 2
    labels = network.components(nodes, edges)
    report = network.component_report(labels).first()
    assert (report["components"], report["largest_share"]) == (2, 0.5)
    assert {r["node"] for r in network.main_component(labels).collect()} == {"A", "B"}


def test_connectors_and_classes(spark):
    raw = [
        '[{"connector_id": "C", "at": 1.0}, {"connector_id": "A", "at": 0.0}, {"connectorId": "B", "at": 0.4}]',
        "[{'connector_id': 08f2, 'at': 1e-05}, {'connector_id': 08f1, 'at': 0.5}]",
        None,
        "",
    ]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = [[c["connector_id"] for c in r[0]] for r in df.select(X.parse_connectors(F.col("raw"))).collect()]
    assert got == [["A", "B", "C"], ["08f2", "08f1"], [], []]
    df = spark.createDataFrame([("trunk", "Longfellow Bridge"), ("trunk", "Memorial Drive"), ("residential", None), ("trunk", None)], "c string, n string")
    assert [r[0] for r in df.select(X.walkable(F.col("c"), F.col("n"))).collect()] == [True, False, True, False]
    df = spark.createDataFrame([("{'access_type': denied, 'when': {'mode': [foot]}}",), ("{'mode': [car]}",), (None,)], "a string")
    assert [r[0] for r in df.select(X.walk_denied_text(F.col("a"))).collect()] == [True, False, False]


def random_graph(seed, n=40, m=70):
    rng = random.Random(seed)
    edges = {}
    for _ in range(m):
        a, b = sorted(rng.sample(range(n), 2))
        edges[a, b] = min(edges.get((a, b), 99.0), float(rng.randrange(1, 9)))
    return edges


def brute(edges, n, start):
    dist = {start: 0.0}
    for _ in range(n):
        for (a, b), w in edges.items():
            for u, v in ((a, b), (b, a)):
                if u in dist and dist[u] + w < dist.get(v, 1e18):
                    dist[v] = dist[u] + w
    return dist


@pytest.mark.parametrize("seed", [1, 2])
def test_two_nearest_against_all_distances(spark, seed):
    edges = random_graph(seed)
    rng = random.Random(seed)
    seeds = [(rng.randrange(40), s, float(rng.randrange(4))) for s in range(7)]
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, metres double")
    got = network.nearest_labels(spark.createDataFrame(seeds, "node long, seed long, metres double"), df).collect()
    want = set()
    everything = {s: {k: v + d0 for k, v in brute(edges, 40, n).items()} for n, s, d0 in seeds}
    for node in range(40):
        ranked = sorted((d[node], s) for s, d in everything.items() if node in d)[:2]
        want |= {(node, s, d, i + 1) for i, (d, s) in enumerate(ranked)}
    assert {(r["node"], r["seed"], r["metres"], r["place"]) for r in got} == want


def test_access_over_a_line(spark):
    nodes = spark.createDataFrame([(i, 42.35, -71.10 + i * 0.01) for i in range(5)], "node long, lat double, lon double")
    step = hav(42.35, -71.10, 42.35, -71.09)
    edges = spark.createDataFrame([(i, i + 1, step) for i in range(4)], "a long, b long, metres double")
    fac = spark.createDataFrame(
        [("left", 0, 42.35, -71.10, True, None), ("right", 1, 42.35, -71.06, True, None), ("far", 2, 42.40, -71.06, True, None)],
        "id string, ord long, lat double, lon double, walk_in boolean, storefront_reason string",
    )
    snapped = access.facility_snaps(fac, nodes)
    state = {r["id"]: (r["routable"], r["exclude_reason"]) for r in snapped.collect()}
    assert state["left"] == (True, None) and state["far"][0] is False and "walk" in state["far"][1]
    cells = spark.createDataFrame([(7, 42.35, -71.09), (8, 43.0, -71.0)], "cell_id long, lat double, lon double")
    rows = {r["cell_id"]: r for r in access.two_nearest(cells, snapped, nodes, edges).collect()}
    assert (rows[7]["nearest_id"], rows[7]["second_id"]) == ("left", "right")
    assert rows[7]["nearest_m"] == pytest.approx(step, abs=0.01) and rows[7]["second_m"] == pytest.approx(3 * step, abs=0.01)
    assert rows[8]["nearest_id"] is None and rows[8]["nearest_m"] is None
    pairs = spark.createDataFrame([("ab", 42.35, -71.10, 42.35, -71.08)], "name string, o_lat double, o_lon double, d_lat double, d_lon double")
    r = network.routes(pairs, nodes, edges).first()
    assert r["modeled_m"] == pytest.approx(2 * step) and r["geodesic_m"] == pytest.approx(2 * step, rel=1e-4)


def test_radius_and_nearest_against_brute_force(spark):
    rng = random.Random(9)
    left = [(i, rng.uniform(-60, 60), rng.uniform(-5, 5)) for i in range(60)] + [(100 + i, rng.uniform(42, 42.2), rng.uniform(-71.2, -71)) for i in range(60)]
    right = [(i, rng.uniform(42, 42.2), rng.uniform(-71.2, -71)) for i in range(50)] + [(60 + i, rng.uniform(-60, 60), rng.uniform(-5, 5)) for i in range(30)]
    l = spark.createDataFrame(left, "point_id long, lat double, lon double")
    r = spark.createDataFrame(right, "target_id long, r_lat double, r_lon double")
    for radius in (300.0, 2000.0, 150_000.0):
        want = {(a, b) for a, y, x in left for b, v, u in right if hav(y, x, v, u) <= radius}
        assert {(p["point_id"], p["target_id"]) for p in spatial.within_radius(l, r, radius).collect()} == want
    got = {(p["point_id"], p["place"]): p["target_id"] for p in spatial.nearest_k(l, r, 2, 1000.0).collect()}
    for a, y, x in left:
        ranked = [b for _, b in sorted((hav(y, x, v, u), b) for b, v, u in right)[:2]]
        assert [got[a, 1], got[a, 2]] == ranked


def test_polygons(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    polygons = spark.createDataFrame([("box", ring)], "name string, ring array<struct<x double, y double>>")
    pts = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.5), (3, 2.0, 2.0), (4, 1.0, 1.0)], "id long, lon double, lat double")
    inside = lambda inclusive: sorted(r["id"] for r in spatial.points_in_polygons(pts, polygons, inclusive).collect())
    assert inside(True) == [1, 2, 4] and inside(False) == [2]
    row = polygons.select(geo.ring_area(F.col("ring")), *geo.ring_centroid(F.col("ring")), geo.distance_to_ring(F.lit(2.0), F.lit(0.5), F.col("ring"))).first()
    assert row[:] == (1.0, 0.5, 0.5, 1.0)
    wkt = spark.createDataFrame([("POLYGON ((0 0, 2 0, 2 1, 0 0))",)], "w string").select(geo.ring_area(geo.parse_polygon(F.col("w")))).first()
    assert wkt[0] == 1.0


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(42.36, -71.06), (41.0, -71.5), (42.9, -73.0)], "lat double, lon double")
    x, y = geo.project(F.col("lat"), F.col("lon"))
    p = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = geo.unproject(F.col("x"), F.col("y"))
    rows = p.select("*", lat.alias("a"), lon.alias("b")).collect()
    for r in rows:
        assert r["a"] == pytest.approx(r["lat"], abs=1e-10) and r["b"] == pytest.approx(r["lon"], abs=1e-10)
    assert (rows[1]["x"], rows[1]["y"]) == (pytest.approx(200000.0), pytest.approx(750000.0))
    near = spark.createDataFrame([([(-71.1, 42.3), (-71.0, 42.3), (-71.0, 42.4), (-71.1, 42.4)],)], "ring array<struct<x double, y double>>")
    tests = [(42.35, -71.05), (42.32, -70.98), (42.32, -70.90)]
    got = [near.select(geo.covered_within(F.lit(a), F.lit(b), F.col("ring"), 3000.0)).first()[0] for a, b in tests]
    assert got == [True, True, False]


def test_points_along_a_line(spark):
    df = spark.createDataFrame([("LINESTRING (0 0, 0 1, 0 3)",)], "w string").withColumn("line", geo.parse_line(F.col("w"))).withColumn("cum", geo.cumulative_m(F.col("line")))
    for at, y in ((0.0, 0.0), (1 / 3, 1.0), (0.5, 1.5), (1.0, 3.0), (2.0, 3.0), (-1.0, 0.0)):
        p = df.select(geo.point_at(F.col("line"), F.col("cum"), F.lit(at)).alias("p")).first()["p"]
        assert p["y"] == pytest.approx(y)
    total = df.select(geo.line_length_m(F.col("line"))).first()[0]
    assert df.select(geo.portion_m(F.lit(total), F.lit(0.75), F.lit(0.25))).first()[0] == pytest.approx(total / 2)


def test_nearest_k_far_targets(spark):
    """Across the antimeridian, near a pole, on the other side of the Earth; no place, no targets, fewer than k."""
    points = spark.createDataFrame(
        [(1, 10.0, 179.9), (2, 89.0, 10.0), (3, -40.0, -60.0), (4, None, 1.0)], "point_id long, lat double, lon double"
    )
    places = [(1, 10.0, -175.0), (2, 85.0, -170.0), (3, 40.0, 100.0)]
    targets = spark.createDataFrame(places, "target_id long, r_lat double, r_lon double")
    for k in (1, 2, 5):
        got = {(r["point_id"], r["place"]): r["target_id"] for r in spatial.nearest_k(points, targets, k=k).collect()}
        want = {}
        for p, lat, lon in [(1, 10.0, 179.9), (2, 89.0, 10.0), (3, -40.0, -60.0)]:
            far = sorted((hav(lat, lon, y, x), t) for t, y, x in places)
            want |= {(p, i + 1): t for i, (_, t) in enumerate(far[:k])}
        assert got == want
    assert spatial.nearest_k(points, targets.limit(0)).collect() == []
