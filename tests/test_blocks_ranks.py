import math
import random

import pytest
from pyspark.sql import functions as F

from footfall.functions import text as X
from footfall.operators import access, closure, network, ranking, reports, spatial


def hav(lat1, lon1, lat2, lon2):
    r = math.radians
    a = math.sin(r(lat2 - lat1) / 2) ** 2 + math.cos(r(lat1)) * math.cos(r(lat2)) * math.sin(r(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(a))


def lattice(spark, side=9):
    """Nodes of a grid of streets with some missing, and one node apart."""
    rng = random.Random(4)
    at = {i: (42 + i // side * 0.002, -71 + i % side * 0.002) for i in range(side * side)}
    edges = [(i, j, float(rng.randrange(1, 9))) for i in at for j in (i + 1, i + side) if j in at and (j != i + 1 or j % side) and rng.random() < 0.85]
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()] + [(999, None, None)], "node long, lat double, lon double")
    return at, edges, nodes, spark.createDataFrame(edges, "a long, b long, metres double")


def distances(edges, start, cost):
    best, waiting = {}, [(cost, start)]
    while waiting:
        waiting.sort(reverse=True)
        m, n = waiting.pop()
        if n in best:
            continue
        best[n] = m
        waiting += [(m + w, v if u == n else u) for u, v, w in edges if n in (u, v)]
    return best


@pytest.mark.parametrize("most", [4, 1000])
def test_labels_by_blocks(spark, most, monkeypatch):
    at, edges, nodes, table = lattice(spark)
    monkeypatch.setattr(network, "LOG_TABLES", 2)
    seeds = [(0, 5, 0.0), (40, 2, 3.0), (80, 9, 0.0), (0, 7, 0.0), (999, 1, 2.0), (None, 3, 0.0), (4, None, 0.0), (4, 8, None), (4, 8, float("nan"))]
    got = network.nearest_labels(spark.createDataFrame(seeds, "node long, seed long, metres double"), table, nodes=nodes, block_nodes=most).collect()
    every = {s: distances(edges, n, m) for n, s, m in seeds[:5]}
    want = set()
    for n in [*at, 999]:
        ranked = sorted((d[n], s) for s, d in every.items() if n in d)[:2]
        want |= {(n, s, m, k + 1) for k, (m, s) in enumerate(ranked)}
    assert {(r["node"], r["seed"], r["metres"], r["place"]) for r in got} == want
    near = network.nearest_labels(spark.createDataFrame(seeds, "node long, seed long, metres double"), table, nodes=nodes, block_nodes=most, limit_m=9.0).collect()
    assert {(r["node"], r["seed"]) for r in near} == {(n, s) for n, s, m, _ in want if m <= 9.0}


def test_rounds_that_run_out_and_seeds_that_are_none(spark):
    _, _, nodes, table = lattice(spark)
    with pytest.raises(RuntimeError):
        network.nearest_labels(spark.createDataFrame([(0, 1, 0.0)], "node long, seed long, metres double"), table, max_rounds=2)
    assert network.distances_from(None, table, nodes).count() == 0
    assert network.nearest_labels(spark.createDataFrame([], "node long, seed string, metres double"), table).count() == 0
    assert network.distances_from(3, table.where("false"), nodes).collect()[0][:] == (3, 0.0)


def test_components_of_a_long_way(spark):
    """Nodes of a way of three hundred in no order, another way, a node apart and edges to unknown nodes."""
    rng = random.Random(8)
    order = rng.sample(range(10, 500), 400)
    ways = order[:300], order[300:]
    edges = [(min(p), max(p), 1.0) for way in ways for p in zip(way, way[1:])] + [(5000, ways[0][0], 1.0), (5000, ways[1][0], 1.0), (7, 7, 1.0), (7, None, 1.0)]
    nodes = spark.createDataFrame([(i,) for i in [7, *order]], "node long")
    got = {r["node"]: r["component"] for r in network.components(nodes, spark.createDataFrame(edges, "a long, b long, metres double"), max_rounds=20).collect()}
    assert got == {7: 7} | {i: min(way) for way in ways for i in way}


def test_blocks_are_small_and_whole(spark):
    at, _, nodes, _ = lattice(spark)
    same = spark.createDataFrame([(2000 + i, 42.5, -71.5) for i in range(40)], nodes.schema)
    got = network.blocks_of(nodes.where("lat is not null").union(same), 10).collect()
    assert {r["node"] for r in got} == {*at, *range(2000, 2040)}
    sizes = {}
    for r in got:
        sizes[r["block"]] = sizes.get(r["block"], 0) + 1
    assert max(sizes.values()) <= 20 and len(sizes) < 45


def test_snaps_in_order_of_degrees(spark):
    rng = random.Random(11)
    nodes = [(i, 42 + rng.uniform(0, 0.05), -71 + rng.uniform(0, 0.05), rng.random() < 0.4) for i in range(150)]
    points = [(i, 42 + rng.uniform(-0.01, 0.06), -71 + rng.uniform(-0.01, 0.06)) for i in range(60)] + [(100, 44.0, -70.0), (101, None, 1.0)]
    n = spark.createDataFrame(nodes, "node long, lat double, lon double, main boolean")
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    for limit, most in ((400.0, 12), (1.0, 3)):
        got = {r["point_id"]: (r["node"], r["snap_m"]) for r in network.snap_reachable(p, n, limit, most).collect()}
        for i, lat, lon in points[:-1]:
            ranked = sorted(((y - lat) ** 2 + (x - lon) ** 2, k, y, x, m) for k, y, x, m in nodes)[:most]
            best = (ranked[0][1], math.inf)
            for _, k, y, x, m in ranked:
                if m and hav(lat, lon, y, x) < best[1]:
                    best = (k, hav(lat, lon, y, x))
                if m and hav(lat, lon, y, x) <= limit:
                    break
            assert got[i][0] == best[0] and got[i][1] == pytest.approx(best[1])
        assert 101 not in got
    assert network.snap_reachable(p, n.where("false")).count() == 0


def test_nearest_in_clusters(spark):
    """Many copies of a place, a far cluster, and few targets beside it."""
    rng = random.Random(3)
    points = [(i, 42.0, -71.0) for i in range(40)] + [(100 + i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(40)]
    targets = [(i, 42.0 + rng.uniform(0, 0.001), -71.0) for i in range(60)] + [(100 + i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(5)]
    got = spatial.nearest_k(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(targets, "target_id long, r_lat double, r_lon double"), 3, 50.0).collect()
    found = {(r["point_id"], r["place"]): r["distance_m"] for r in got}
    for i, lat, lon in points:
        for place, m in enumerate(sorted(hav(lat, lon, y, x) for _, y, x in targets)[:3], 1):
            assert found[i, place] == pytest.approx(m, abs=1e-6)


def test_dense_places_meet_few_targets(spark):
    """Places within one cube of the starting size meet the targets around them only; copies of targets go by id."""
    rng = random.Random(6)
    points = [(i, 42 + rng.uniform(0, 0.01), -71 + rng.uniform(0, 0.01)) for i in range(1500)]
    spots = [(42 + rng.uniform(0, 0.01), -71 + rng.uniform(0, 0.01)) for _ in range(500)]
    targets = [(3 * i + c, *spots[i]) for i in range(500) for c in (2, 0, 1)]
    p, t = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(targets, "target_id long, r_lat double, r_lon double")
    axes = spatial.sphere_axes("lat", "lon"), spatial.sphere_axes("r_lat", "r_lon")
    assert spatial.candidate_pairs(p, t, axes, 2, 2000.0 / 6371000, 2.0).count() < 1500 * 1500 / 4
    got = {(r["point_id"], r["place"]): r["target_id"] for r in spatial.nearest_k(p.where("point_id < 60"), t, 4, 2000.0).collect()}
    for i, lat, lon in points[:60]:
        ranked = sorted((hav(lat, lon, y, x), k) for k, y, x in targets)
        assert [got[i, n] for n in (1, 2, 3, 4)] == [k for _, k in ranked[:4]]


def test_rank_of_a_whole_table(spark):
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(20))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    got = {r["id"]: (r["rank"], r["of"]) for r in ranking.whole_rank(df, F.desc("v"), F.col("id").asc()).collect()}
    assert got == {i: (k, 500) for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert ranking.whole_rank(df.where("false"), F.asc("id")).columns == ["id", "v", "rank", "of"]
    names = ["b", "Äa", "ab", "B", "a", "é", "z"]
    ranked = ranking.whole_rank(spark.createDataFrame([(n,) for n in names], "id string"), F.collate("id", "UNICODE").asc()).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == ["a", "Äa", "ab", "b", "B", "é", "z"]


def test_printed_lists_entry_by_entry(spark):
    raw = "[{'connector_id': aa}, {'connector_id': bb, 'at': 0.5}, {'connector_id': cc, 'at': 1.0}, {'at': 0.2}]"
    texts = [raw, "[Row(connector_id='x', at=None), Row(connector_id='y', at=2e-1)]", "no list at all"]
    got = [[(c["connector_id"], c["at"]) for c in r[0]] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.parse_connectors(F.col("t"))).collect()]
    assert got == [[("aa", 0.0), ("bb", 0.5), ("cc", 1.0)], [("x", 0.0), ("y", 0.2)], []]


def test_denial_by_rules_and_by_words(spark):
    rules = ['[{"access_type":"denied","when":{"mode":["foot"]}}]', '[{"access_type":"allowed","when":{"mode":["foot"]}}]', "node on foot", None, '[{"access_type":"denied","when":null}]']
    df = spark.createDataFrame([(i, "road", "footway", None, r) for i, r in enumerate(rules)], "id int, subtype string, class string, name string, access_json string")
    assert sorted(r["id"] for r in network.walkable_segments(df).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in network.walkable_segments(df, by_text=True).collect()) == [1, 3, 4]


@pytest.mark.parametrize("most", [6, 1000])
def test_walks_between_pairs(spark, most):
    at, edges, nodes, table = lattice(spark)
    apart = [(500, 501, 2.0)]
    table = table.union(spark.createDataFrame(apart, table.schema))
    nodes = nodes.union(spark.createDataFrame([(500, 42.001, -71.001), (501, 42.001, -71.0011)], nodes.schema))
    rng = random.Random(2)
    pairs = [(f"p{i}", *rng.sample(sorted(at), 2)) for i in range(25)] + [("same", 3, 3), ("apart", 500, 501), ("no way", 500, 3), ("none", None, 3), ("unknown", 7777, 3)]
    got = {r["name"]: r["metres"] for r in network.shortest_walks(spark.createDataFrame(pairs, "name string, o_node long, d_node long"), nodes, table, block_nodes=most).collect()}
    want = {}
    for name, o, d in pairs[:-2]:
        found = distances(edges + apart, o, 0.0)
        if d in found:
            want[name] = found[d]
    assert got == pytest.approx(want)
    with pytest.raises(RuntimeError):
        network.shortest_walks(spark.createDataFrame(pairs, "name string, o_node long, d_node long"), nodes, table, max_rounds=1, block_nodes=most).collect()


def test_walks_over_edges_that_do_not_follow_places(spark):
    """A ring of nodes at places in no order, with shortcuts: two rounds are enough."""
    rng = random.Random(12)
    edges = {(min(p), max(p)): float(rng.randrange(1, 50)) for i in range(400) for p in ((i, (i + 1) % 400), (i, (i * 3 + 1) % 400)) if p[0] != p[1]}
    edges = [(a, b, m) for (a, b), m in edges.items()] + [(900, 901, 1.5)]
    nodes = [(i, 42 + rng.uniform(0, 0.1), -71 + rng.uniform(0, 0.1)) for i in [*range(400), 900, 901]]
    pairs = [(i, *rng.sample(range(400), 2)) for i in range(200)] + [(200, 5, 5), (201, 900, 901), (202, 900, 3), (203, 7777, 7777)]
    tables = spark.createDataFrame(pairs, "name long, o_node long, d_node long"), spark.createDataFrame(nodes, "node long, lat double, lon double"), spark.createDataFrame(edges, "a long, b long, metres double")
    got = {r["name"]: r["metres"] for r in network.shortest_walks(*tables, max_rounds=2, block_nodes=20).collect()}
    want = {name: d for name, o, g in pairs[:202] if (d := distances(edges, o, 0.0).get(g)) is not None}
    assert got == pytest.approx(want | {203: 0.0})


def test_street_report(spark):
    at, edges, nodes, table = lattice(spark)
    nodes = nodes.where("lat IS NOT NULL")
    walks = spark.createDataFrame([("across", *at[0], *at[80]), ("same", *at[3], *at[3])], "name string, o_lat double, o_lon double, d_lat double, d_lon double")
    segments = spark.createDataFrame([(0, "Long Bridge"), (1, "Main"), (2, None), (3, "Long Bridge")], "ord int, name string")
    row = reports.street_report(nodes, table, segments, walks, {"bridge": r"\bBridge\b", "none": "xyz"}).first()
    assert row["routes_m"] == {"across": round(distances(edges, 0, 0.0)[80], 1), "same": 0.0} and row["connected"] and row["segments"] == 4
    assert row["name_hits"] == {"bridge": ["Long Bridge"], "none": []} and row["nodes"] == 81 and row["all_pass"] == row["dominant"]
    far = spark.createDataFrame([("out", 10.0, 10.0, *at[0])], walks.schema)
    assert reports.street_report(nodes, table, segments, far, {}).first()["all_pass"] is False


def test_sample_walks(spark):
    rows = [("a", "bridge", 1500.0, 735.0, 1011.0, 1.04, None), ("b", "bridge", 737.0, 686.0, None, 1.0, 2.0), ("c", "landmark", None, 58.0, 1000.0, 1.0, 2.0)]
    checked = reports.checked_walks(spark.createDataFrame(rows, "name string, kind string, modeled_m double, geodesic_m double, reference_m double, snap_o_m double, snap_d_m double"))
    got = {r["name"]: r for r in checked.collect()}
    assert (got["a"]["ok"], got["a"]["bridge_ok"], got["a"]["modeled_over_geodesic"], got["a"]["snap_o_m"]) == (False, False, 2.041, 1.0)
    assert (got["b"]["ok"], got["b"]["modeled_over_reference"], got["c"]["ok"], got["c"]["bridge_ok"]) == (True, None, False, True)
    with pytest.raises(ValueError, match="'a'"):
        reports.assert_bridges(checked)
    reports.assert_bridges(checked.where("name <> 'a'"))


def test_thresholds_in_range():
    assert closure.check_threshold(15) == 15.0
    for bad in (4, 31):
        with pytest.raises(ValueError):
            closure.check_threshold(bad)


def test_named_facilities_by_tiles(spark, monkeypatch):
    """Few pairs of many decide; facilities of one place, too near ones and far points included."""
    monkeypatch.setattr(access, "TILE_PLACES", 16)
    rng = random.Random(15)
    shops = [(f"s{i}", f"{('Red', 'Blue')[i % 2]} shop", i, 42 + rng.uniform(0, 0.05), -71 + rng.uniform(0, 0.05)) for i in range(200)]
    shops += [(f"t{i}", n, 1000 - i, y, x) for i, (_, n, _, y, x) in enumerate(shops[:40])] + [("one", "Only", 2000, 42.02, -70.98)]
    asked = [(i, 42 + rng.uniform(0, 0.05), -71 + rng.uniform(0, 0.05), ("red", "Blue", "Pharmacy", "only")[i % 4]) for i in range(80)] + [(90, -30.0, 100.0, "red"), (91, 42.02, -70.98, "ONLY")]
    points, facilities = spark.createDataFrame(asked, "point_id long, lat double, lon double, hint string"), spark.createDataFrame(shops, "id string, name string, ord long, lat double, lon double")
    got = {r["point_id"]: r["id"] for r in access.nearest_named(points, facilities, 1500.0).collect()}
    for i, lat, lon, hint in asked:
        fit = [(hav(lat, lon, y, x) < 1500.0, hav(lat, lon, y, x), o, k) for k, n, o, y, x in shops if hint == "Pharmacy" or hint.lower() in n.lower()]
        assert got[i] == min(fit)[3]
    spots = points.where("hint = 'Pharmacy'").selectExpr("'' AS hint", "lat", "lon")
    stands = facilities.selectExpr("'' AS hint", "lat AS r_lat", "lon AS r_lon", "ord", "id")
    assert access._first_beyond(spots, stands, 1500.0).count() < 20 * 3
