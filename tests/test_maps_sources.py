import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from footfall.operators import access, clusters
from footfall.operators import demand as D
from footfall.sources import shapefiles, sinks


def write_shapefile(stem, polygons):
    """A shapefile of polygons (name, rings), by the published layout."""
    shp, shx, at = b"", b"", 100
    for k, (_, rings) in enumerate(polygons):
        closed = [[*r, r[0]] for r in rings]
        points = [p for r in closed for p in r]
        starts = [sum(len(r) for r in closed[:i]) for i in range(len(closed))]
        body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(closed), len(points)) + struct.pack(f"<{len(starts)}i", *starts)
        body += b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at // 2, len(body) // 2)
        at += 8 + len(body)
    stem.with_suffix(".shp").write_bytes(bytes(100) + shp)
    stem.with_suffix(".shx").write_bytes(bytes(100) + shx)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([9]) + bytes(15)
    rows = b"".join(b" " + n.encode().ljust(9) for n, _ in polygons)
    stem.with_suffix(".dbf").write_bytes(struct.pack("<B3BIHH", 3, 1, 1, 1, len(polygons), 65, 10) + bytes(20) + field + b"\r" + rows)


@pytest.mark.parametrize("records", [1, 3, 100])
def test_a_shapefile_in_many_tasks(spark, tmp_path, records):
    polygons = [(f"p{k}", [[(k, 0.0), (k + 1.0, 0.0), (k + 1.0, 1.0)]] + [[(k, 5.0), (k + 0.5, 5.0), (k, 6.0)]] * (k % 2)) for k in range(8)]
    write_shapefile(tmp_path / "t", polygons)
    df = shapefiles.read_shapes(spark, f"{tmp_path}/t.shp", records)
    assert df.rdd.getNumPartitions() == math.ceil(8 / records)
    got = {r["record"]: (r["attributes"]["NAME"], [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]) for r in df.collect()}
    assert got == {k: (n, [[(float(x), y) for x, y in r] for r in rings]) for k, (n, rings) in enumerate(polygons)}
    write_shapefile(tmp_path / "none", [])
    assert shapefiles.read_shapes(spark, f"file://{tmp_path}/none.shp").count() == 0


def test_clusters_of_every_zoom(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(41, 43), rng.uniform(-72, -70)) for i in range(300)] + [(900, None, 1.0), (901, 90.0, 180.0), (902, -90.0, -180.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    levels = clusters.cluster_levels(df).collect()
    for zoom in (0, 5, 9, 12):
        own = {(r["cx"], r["cy"]): r for r in levels if r["zoom"] == zoom}
        assert sum(r["points"] for r in own.values()) == 302
        members = df.where("lat is not null").select("lat", "lon", clusters.cluster_of(F.col("lat"), F.col("lon"), zoom).alias("c")).collect()
        for key, r in own.items():
            inside = [m for m in members if m["c"][:] == key]
            assert len(inside) == r["points"] and r["lon"] == pytest.approx(sum(m["lon"] for m in inside) / len(inside), abs=1e-6)
            assert min(m["lat"] for m in inside) - 6 <= r["lat"] <= max(m["lat"] for m in inside) + 6
    sizes = [sum(r["zoom"] == z for r in levels) for z in range(13)]
    assert sizes == sorted(sizes)
    assert clusters.cluster_levels(df.where("false"), 2).count() == 0


def test_names_that_hold_a_hint(spark):
    rng = random.Random(7)
    names = ["CVS Pharmacy", "Star Market", "Corner Drug", None, "cvs 12"]
    fac = [(f"f{i}", i, rng.choice(names), 42 + rng.uniform(0, 0.05), -71 + rng.uniform(0, 0.05)) for i in range(80)]
    asked = [(i, 42 + rng.uniform(0, 0.05), -71 + rng.uniform(0, 0.05), rng.choice(["CVS", "pharmacy", "market", "r", "", "nowhere"])) for i in range(50)] + [(90, None, 1.0, "r"), (91, 42.0, -71.0, None)]
    got = {r["point_id"]: (r["id"], r["distance_m"]) for r in access.nearest_named(
        spark.createDataFrame(asked, "point_id long, lat double, lon double, hint string"), spark.createDataFrame(fac, "id string, ord long, name string, lat double, lon double"), 900.0).collect()}
    from test_blocks_ranks import hav

    for i, lat, lon, hint in asked[:-2]:
        fits = [(hav(lat, lon, y, x) < 900, hav(lat, lon, y, x), o, f) for f, o, n, y, x in fac if hint.lower() == "pharmacy" or hint.lower() in (n or "").lower()]
        assert (got[i][0] if fits else got.get(i)) == (min(fits)[3] if fits else None)
    assert not {90, 91} & set(got)


def test_a_geoid_is_one_block_group(spark):
    bgs = spark.createDataFrame([("a", "B", 0.0, 0.0, 10.0), ("a", "B", 0.0, 0.0, 20.0)], "geoid string, city string, lat double, lon double, no_vehicle double")
    mapped = spark.createDataFrame([("home", 0.0, 0.0, 2.0, True, "a", "B")], "id string, lat double, lon double, weight double, residential boolean, geoid string, city string")
    with pytest.raises(Exception, match="several block groups with geoid a"):
        D.allocate(mapped, bgs).collect()


def test_published_document(spark, tmp_path):
    cells = spark.createDataFrame([(k, f"h{k}", "x", 5.0, 42.0, -71.0, "f", 1.0, None, None) for k in (2, 0, 1)], "ord int, h3 string, city string, households double, lat double, lon double, nearest_id string, nearest_m double, second_id string, second_m double")
    facilities = spark.createDataFrame([(0, "f", "F", "1 St", "x", 42.0, -71.0, "high", True, True, None)], "ord int, id string, name string, address string, city string, lat double, lon double, confidence string, in_study_area boolean, simulatable boolean, exclude_reason string")
    sinks.publish(cells.repartition(3), facilities, {"pace": 1}, f"{tmp_path}/out")
    doc = json.loads((tmp_path / "out" / "artifact.json").read_text())
    assert doc == json.loads(sinks.artifact(cells, facilities, {"pace": 1}).first()["document"])
    assert [h["h3"] for h in doc["hexes"]] == ["h0", "h1", "h2"] and doc["hexes"][0]["secondId"] is None
