import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from footfall.operators.closure import closure_table
from footfall.plans.build import run_steps
from footfall.sources import archives, layers, sinks
from footfall.streaming import status


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Notes.csv", "x\n1\n")
        z.writestr("Data_1.csv", "License,Zip\nDS1,02139\nDS2,\n")
    rows = archives.read_zipped_csv(spark, str(tmp_path / "a.zip"), ["License", "Zip", "None"]).orderBy("ord").collect()
    assert [r[:] for r in rows] == [(0, "DS1", "02139", None), (1, "DS2", None, None)]


def shapefile(path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body
    field = b"GEOID".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4, 0]) + bytes(14)
    dbf = struct.pack("<4BIHH", 3, 1, 1, 1, 1, 65, 5) + bytes(20) + field + b"\r" + b" 2501"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("bg.shp", shp)
        z.writestr("bg.dbf", dbf)


def test_shapefile(spark, tmp_path):
    shapefile(tmp_path / "s.zip")
    row = archives.read_shapefile(spark, str(tmp_path / "s.zip")).first()
    assert row["attributes"] == {"GEOID": "2501"} and [(p["x"], p["y"]) for p in row["ring"]] == [(0, 0), (0, 1), (1, 1)]


def test_extract_is_made_once_and_checked(spark, tmp_path):
    root = f"{tmp_path}/root"
    df = spark.range(10).select(
        F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.col("id").cast("double").alias("lon"), F.lit(0.5).alias("lat"),
        F.struct(F.col("id").cast("double").alias("xmin"), F.lit(0.5).alias("ymin"), F.col("id").cast("double").alias("xmax"), F.lit(0.5).alias("ymax")).alias("bbox"),
    )
    df.write.parquet(layers.layer_path(root, "places", "place"))
    assert layers.first_readable(spark, [f"{tmp_path}/none", root], "places", "place") == root
    with pytest.raises(FileNotFoundError):
        layers.first_readable(spark, [f"{tmp_path}/none"], "places", "place")
    target = f"{tmp_path}/places.parquet"
    out = layers.extract_layer(spark, root, "places", "place", (2.0, 0.0, 5.0, 1.0), target, points=True)
    assert out.count() == 4
    assert layers.extract_layer(spark, root, "places", "place", (2.0, 0.0, 5.0, 1.0), target, points=True).count() == 4
    assert layers.extract_layer(spark, root, "places", "place", (2.0, 0.0, 3.0, 1.0), target, points=True).count() == 2
    with pytest.raises(ValueError):
        layers.require_columns(out, ["id", "missing"])
    with pytest.raises(ValueError):
        layers.extract_layer(spark, root, "places", "place", (50.0, 0.0, 51.0, 1.0), f"{tmp_path}/b.parquet")
    assert layers.select_if_present(out, {"id": F.col("id"), "gone": F.lit(1)}).columns == ["id"]


def test_geojson_both_ways(spark, tmp_path):
    df = spark.createDataFrame([("Boston", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "name string, ring array<struct<x double, y double>>")
    sinks.write_geojson(df, f"{tmp_path}/c.geojson")
    row = layers.read_geojson(spark, f"{tmp_path}/c.geojson").first()
    assert row["name"] == "Boston" and len(row["ring"]) == 3 and row["ring"][2]["y"] == 1.0


def test_delimited_report_and_ledger(spark, tmp_path):
    (tmp_path / "a.dat").write_text("GEO_ID|A|B\n1500000US25|007|x\n")
    row = layers.read_delimited(spark, f"{tmp_path}/a.dat", ["GEO_ID", "A"]).first()
    assert row[:] == ("1500000US25", "007")
    assert sinks.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/r.json") == {"a": 1, "b": "x"}
    calls = []

    def bad():
        raise RuntimeError("no")

    done = run_steps(spark, [("one", lambda: calls.append(1)), ("opt", bad), ("two", lambda: calls.append(2))], f"{tmp_path}/l.json", ["opt"])
    assert calls == [1, 2] and [d["ok"] for d in done] == [True, False, True]
    with pytest.raises(RuntimeError):
        run_steps(spark, [("opt", bad)], f"{tmp_path}/l.json")
    assert json.loads((tmp_path / "l.json").read_text())["steps"][0]["ok"] is False


CELLS = "ord long, h3 string, city string, households double, nearest_id string, nearest_m double, second_id string, second_m double"


def test_stream_keeps_the_table_current(spark, tmp_path):
    cells = spark.createDataFrame([(0, "a", "x", 5.0, "f", 100.0, "g", 3000.0), (1, "b", "x", 7.0, "g", 100.0, "f", 900.0)], CELLS)
    facilities = spark.createDataFrame([("f", True, True), ("g", True, False)], "id string, in_study_area boolean, simulatable boolean")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "g", "simulatable": true, "changed_at": "2024-01-01T00:00:00Z"}\n{"id": "f", "simulatable": false, "changed_at": "2024-01-01T00:00:00Z"}')
    seen = {}

    def write(df, number):
        seen[number] = {r["id"]: r["newly_households"] for r in df.collect()}

    changes = status.read_changes(spark, f"{tmp_path}/in")
    status.keep_current(changes, cells, lambda: facilities, write, f"{tmp_path}/cp", 1.34112, 15.0).awaitTermination()
    assert seen == {0: {"g": 0.0}}
    batch = spark.read.schema(status.CHANGES).json(f"{tmp_path}/in")
    row = status.changes_by_window(batch).first()
    assert (row["opened"], row["closed"]) == (1, 1)
    assert closure_table(cells, 1.34112, 15.0).count() == 2


def test_artifact(spark):
    from footfall.plans import queries

    doc = json.loads(queries.artifact_document(spark, "/root/testdata/sf0.001").first()["document"])
    assert doc["meta"]["threshold_minutes"] == 15 and doc["hexes"] and doc["facilities"]
    assert set(doc["hexes"][0]) >= {"h3", "households", "nearestId", "nearestM", "secondId", "secondM"}
