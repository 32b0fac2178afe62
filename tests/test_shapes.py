import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.functions import polygons as P
from footfall.operators import shapes, spatial
from footfall.sources import layers, sinks

RINGS = "array<array<struct<x double, y double>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def frame(spark, rows, columns):
    return spark.createDataFrame([(*r[:-1], [[(float(x), float(y)) for x, y in ring] for ring in r[-1]]) for r in rows], f"{columns}, rings {RINGS}")


def star(rng, n, cx=0.0, cy=0.0, r=1.0):
    a, d = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1, n) * r
    return np.c_[cx + d * np.cos(a), cy + d * np.sin(a)]


def inside(polygon, p):
    odd = np.zeros(len(p), bool)
    for ring in polygon:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0)):
            with np.errstate(all="ignore"):
                odd ^= ((y0 > p[:, 1]) != (y1 > p[:, 1])) & (p[:, 0] < x0 + (p[:, 1] - y0) * (x1 - x0) / (y1 - y0))
    return odd


@pytest.mark.parametrize("how", ["intersection", "union", "difference"])
def test_overlays_of_concave_polygons_with_holes(how):
    rng = np.random.default_rng(3)
    places = rng.uniform(-2, 2, (60_000, 2))
    for _ in range(6):
        a, b = [star(rng, 12), star(rng, 7, r=0.25)], [star(rng, 9, 0.4, 0.3), star(rng, 5, -1, 0.2)]
        ia, ib = inside(a, places), inside(b, places)
        want = {"intersection": ia & ib, "union": ia | ib, "difference": ia & ~ib}[how]
        strips = P.overlay([a, b], how)
        rings = P.rings_of(strips)
        area = sum(map(P.area_of, strips))
        shoelace = sum((r[:, 0] * np.roll(r[:, 1], -1) - r[:, 1] * np.roll(r[:, 0], -1)).sum() / 2 for r in rings)
        assert area == pytest.approx(shoelace, abs=1e-9) and area == pytest.approx(want.mean() * 16, abs=0.15)
        assert (inside(rings, places) == want).mean() > 0.9998
        place = np.array([P.point_of(np.concatenate(strips))])
        assert {"intersection": inside(a, place) & inside(b, place), "union": inside(a, place) | inside(b, place), "difference": inside(a, place) & ~inside(b, place)}[how].all()


def test_touching_and_empty_polygons(spark):
    rings = P.rings_of(P.overlay([[np.array(box(0, 0, 2, 2), float)], [np.array(box(2, 0, 4, 2), float)]], "union"))
    assert len(rings) == 1 and len(rings[0]) == 4
    df = frame(spark, [(1, [box(0, 0, 1, 1)]), (2, []), (3, [box(5, 5, 6, 6)]), (4, [[(0, 0), (1, 1)]])], "id int")
    df = df.unionByName(spark.createDataFrame([(5, None)], df.schema))
    other = F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in box(0.5, 0, 2, 1)]))
    out = df.select("id", P.overlay_area(F.col("rings"), other).alias("a"), P.overlay_rings(F.col("rings"), other).alias("r"), P.overlay_facts(F.col("rings"), other).alias("f"))
    got = {r["id"]: r for r in out.collect()}
    assert {k: r["a"] for k, r in got.items()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: None}
    assert [len(got[k]["r"]) for k in (1, 2, 3, 4)] == [1, 0, 0, 0] and got[5]["r"] is None
    assert got[1]["f"][:] == (0.5, 0.75, 0.5) and got[3]["f"] is None


def test_places_on_holes(spark):
    df = frame(spark, [("h", [box(0, 0, 4, 4), box(1, 1, 3, 3)[::-1], box(6, 0, 7, 1)])], "name string")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, 6.5, 0.5), (5, 5.0, 0.5), (6, 0.0, 2.0)], "id int, lon double, lat double")
    got = lambda inclusive: sorted(r["id"] for r in spatial.points_in_polygons(pts, df, inclusive, size=0.7).collect())
    assert got(True) == [1, 3, 4, 6] and got(False) == [1, 4]
    row = df.select(P.polygon_area(F.col("rings")), *P.polygon_centroid(F.col("rings")), F.size(P.polygon_sides(F.col("rings")))).first()
    assert row[0] == 13.0 and row[1] == pytest.approx((12 * 2 + 6.5) / 13) and row[2] == pytest.approx((12 * 2 + 0.5) / 13) and row[3] == 12


def test_texts_of_polygons(spark):
    rows = [("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1))",), ("multipolygon(((0 0,1 0,1 1)),((5 5,6 5,6 6,5 5)))",), ("POINT (1 2)",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "w string").select(P.parse_rings(F.col("w"))).collect()]
    assert [[len(r) for r in g] if g else g for g in got] == [[4, 3], [3, 3], None, None]
    assert got[0][0][1][:] == (4.0, 0.0)


def test_features_keep_holes(spark, tmp_path):
    df = frame(spark, [("a", [box(0, 0, 4, 4), box(1, 1, 2, 2)]), ("b", [box(9, 9, 10, 10)])], "name string").repartition(2)
    sinks.write_geojson(df, f"{tmp_path}/one.geojson")
    sinks.write_features(df, f"{tmp_path}/many")
    for back in (layers.read_geojson(spark, f"{tmp_path}/one.geojson"), layers.read_features(spark, f"{tmp_path}/many")):
        got = {r["name"]: r for r in back.collect()}
        assert [len(r) for r in got["a"]["rings"]] == [4, 4] and got["a"]["ring"] == got["a"]["rings"][0] and len(got["b"]["rings"]) == 1
        assert {r["name"]: r["rings"] for r in df.collect()} == {k: r["rings"] for k, r in got.items()}
    sinks.write_text(spark, f"{tmp_path}/parts.geojson", '{"type":"FeatureCollection","features":[{"properties":{"name":"m"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    parts = layers.one_shape(layers.read_geojson(spark, f"{tmp_path}/parts.geojson")).collect()
    assert len(parts) == 1 and [len(r) for r in parts[0]["rings"]] == [3, 3]


def test_union_counts_overlaps_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [[star(rng, 8, *rng.uniform(0, 3, 2)).tolist()] for _ in range(60)]
    rows += [rows[0]] * 100 + [[]]
    df = frame(spark, [(i, r) for i, r in enumerate(rows)], "id int")
    places = rng.uniform(-1, 4, (40_000, 2))
    want = np.zeros(len(places), bool)
    for r in rows[:60]:
        want |= inside([np.array(x) for x in r], places)
    monkeypatch.setattr(shapes, "FAN", 4)
    areas = [shapes.union_area(shapes.union_pieces(df, size)).first()["area"] for size in (1.0, 50.0)]
    assert areas[0] == pytest.approx(areas[1], rel=1e-9) and areas[0] == pytest.approx(want.mean() * 25, abs=0.2)
    assert shapes.union_area(shapes.union_pieces(df.where("false"), 1.0)).first()["area"] == 0.0


def test_clipping_of_concave_shapes(spark):
    rng = np.random.default_rng(8)
    own, area = [star(rng, 9, k, 0.3 * k) for k in range(5)], [star(rng, 11, k * 1.3, 0.5) for k in range(3)]
    left = frame(spark, [(k, [r.tolist()]) for k, r in enumerate(own)] + [(99, [box(50, 50, 51, 51)])], "id int")
    pieces = shapes.union_pieces(frame(spark, [(k, [r.tolist()]) for k, r in enumerate(area)], "id int"), 0.7)
    got = {r["id"]: r for r in shapes.clip(left, pieces, 0.7).collect()}
    assert 99 not in got
    for k, r in enumerate(own):
        places = rng.uniform(r.min(axis=0), r.max(axis=0), (30_000, 2))
        mine = inside([r], places)
        both = mine & np.any([inside([a], places) for a in area], axis=0)
        if k in got:
            assert got[k]["clip_ratio"] == pytest.approx(both.sum() / mine.sum(), abs=0.02)
            at = np.array([[got[k]["lon"], got[k]["lat"]]])
            assert inside([r], at).all() and any(inside([a], at).all() for a in area)
        else:
            assert not both.any()


def test_town_of_the_centroid_then_of_the_largest_share(spark):
    towns = frame(spark, [(1, "Boston", [box(0, 0, 2, 2)]), (2, "Brookline", [box(2, 0, 4, 2)])], "ord int, name string")
    shape = frame(spark, [("b", [box(0.9, 0.9, 1.1, 1.1)]), ("k", [box(2.9, 0.9, 3.1, 1.1)]), ("edge", [box(4.0, 1.0, 4.0001, 1.0001)]), ("far", [box(9, 9, 10, 10)])], "id string")
    assert {r["id"]: r["town"] for r in shapes.assign_towns(shape, towns, 0.5).collect()} == {"b": "Boston", "k": "Brookline", "edge": "Brookline"}
    apart = frame(spark, [(1, "Boston", [box(0, 0, 1, 1)]), (2, "Brookline", [box(2, 0, 3, 1)])], "ord int, name string")
    gap = frame(spark, [("g", [box(0.8, 0.2, 2.6, 0.8)]), ("even", [box(0.5, 0.2, 2.5, 0.8)])], "id string")
    assert {r["id"]: r["town"] for r in shapes.assign_towns(gap, apart, 0.5).collect()} == {"g": "Brookline", "even": "Boston"}
    groups = shapes.study_block_groups(gap.withColumnRenamed("id", "geoid"), apart, 0.5).collect()
    assert {r["geoid"]: (r["city"], round(r["clip_ratio"], 9)) for r in groups} == {"g": ("Brookline", round(0.8 / 1.8, 9)), "even": ("Boston", 0.5)}


def test_towns_that_others_hide(spark):
    """Of many towns over each other a place meets few, and still the first that holds it; an outline far away makes no strips."""
    rng = np.random.default_rng(9)
    rows = [(i, f"t{i}", [box(x, y, x + w, y + h)]) for i, (x, y, w, h) in enumerate(np.c_[rng.uniform(0, 2, (200, 2)), rng.uniform(0.3, 1.5, (200, 2))])]
    towns = frame(spark, rows, "ord int, name string")
    places = rng.uniform(-0.2, 3.5, (60, 2))
    small = frame(spark, [(i, [box(x - 0.01, y - 0.01, x + 0.01, y + 0.01)]) for i, (x, y) in enumerate(places)], "id int")
    met = small.select("id", F.col("rings")[0][2].alias("p")).select("id", spatial.bucket(F.col("p.x") - 0.01, 1.0 / 16).alias("_gx"), spatial.bucket(F.col("p.y") - 0.01, 1.0 / 16).alias("_gy"))
    assert met.join(shapes.first_towns(towns, 1.0), ["_gx", "_gy"]).count() < 60 * 20
    got = {r["id"]: r["town"] for r in shapes.assign_towns(small, towns, 1.0).collect()}
    for i, (x, y) in enumerate(places):
        holds = [n for _, n, [[(x0, y0), _, (x1, y1), _]] in rows if x0 <= x <= x1 and y0 <= y <= y1]
        assert not holds or got[i] == holds[0]
    ragged = [np.array([*((k * 0.01, (k % 7) * 0.01) for k in range(400)), (4.0, 3.0), (0.0, 3.0)])]
    layers_ = P.overlay([[np.array(box(1, 1, 2, 2), float)], ragged])
    assert len(layers_) == 1 and sum(map(P.area_of, layers_)) == pytest.approx(1.0)
