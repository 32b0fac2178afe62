import pytest
from pyspark.sql import functions as F

from footfall.operators import access as A
from footfall.operators import demand as D


def test_allocation_prefers_homes_and_keeps_households(spark):
    bgs = spark.createDataFrame(
        [("a", "B", 0.0, 0.0, 10.0), ("b", "B", 0.0, 0.0, 20.0), ("c", "B", 1.0, 2.0, 30.0)], "geoid string, city string, lat double, lon double, no_vehicle double"
    )
    mapped = spark.createDataFrame(
        [("home", 0.0, 0.0, 2.0, True, "a", "B"), ("shop", 0.0, 0.0, 8.0, False, "a", "B"), ("unknown", 0.0, 0.0, 4.0, False, "b", "B")],
        "id string, lat double, lon double, weight double, residential boolean, geoid string, city string",
    )
    out = D.allocate(mapped, bgs)
    ids = {r["id"]: r["hh"] for r in out.collect()}
    assert set(ids) == {"home", "unknown", "block-group:c"} and sum(ids.values()) == pytest.approx(60)
    D.assert_mass(out, bgs)
    with pytest.raises(ValueError):
        D.assert_mass(out.where("id <> 'home'"), bgs)


def clip(spark, rows):
    return spark.createDataFrame(rows, "geoid string, no_vehicle double, no_vehicle_moe double, clip_ratio double")


def test_clipping(spark):
    small = clip(spark, [("a", 100.0, 10.0, 1.0), ("b", 100.0, 10.0, 0.995)])
    assert D.clip_stats(small).first()["partial_clip_block_groups"] == 0
    assert D.scale_to_inside(small).agg(F.sum("no_vehicle"), F.bool_or("scaled")).first()[:] == (200.0, False)
    large = clip(spark, [("a", 100.0, 10.0, 0.5)])
    assert D.clip_stats(large).first()["partial_clip_block_groups"] == 1
    row = D.scale_to_inside(large).first()
    assert (row["no_vehicle"], row["no_vehicle_moe"], row["scaled"]) == (50.0, 5.0, True)


def test_weights_and_residential(spark):
    df = spark.createDataFrame(
        [(100.0, 3.0, None, "residential", None), (100.0, None, 6.2, None, "house"), (0.0, None, 1.0, "unknown", "shop"), (None, None, None, "commercial", "dormitory")],
        "area double, floors double, height double, subtype string, class string",
    )
    rows = df.select(D.building_weight(F.col("area"), F.col("floors"), F.col("height")), D.is_residential(F.col("subtype"), F.col("class"))).collect()
    assert [r[0] for r in rows] == [300.0, 200.0, 80.0, 80.0]
    assert [r[1] for r in rows] == [True, True, False, True]


def test_census_text(spark):
    names = ["GEO_ID", "B25044_E001", "B25044_M001", "B25044_E003", "B25044_M003", "B25044_E010", "B25044_M010"]
    raw = spark.createDataFrame([("1500000US250010001001", "9", "1", "2", "3", "x", "4"), ("1500000US360010001001", *"123456")], ", ".join(f"{n} string" for n in names))
    rows = D.census_rows(raw).collect()
    assert len(rows) == 1 and rows[0]["geoid"] == "250010001001"
    assert (rows[0]["no_vehicle"], rows[0]["no_vehicle_moe"]) == (2.0, 5.0)


def test_walk_checks(spark):
    rows = [(737.0, 686.0, 4224.0, "bridge"), (736.0, 735.0, 1011.0, "bridge"), (1500.0, 735.0, 1011.0, "bridge"), (76.0, 58.0, 1000.0, "landmark"), (None, 58.0, 1000.0, "landmark")]
    df = spark.createDataFrame(rows, "m double, g double, r double, kind string")
    got = [r[0] for r in df.select(A.pair_ok(F.col("m"), F.col("g"), F.col("r"), F.col("kind"))).collect()]
    assert got == [True, True, False, True, False]
    pairs = spark.createDataFrame([(None, 5.0), (1000.0, 0.0), (0.0, 0.0), (1100.0, 900.0), (2000.0, 400.0)], "m double, r double")
    rows = pairs.select(A.walk_ratio(F.col("m"), F.col("r")), A.within_ratio(F.col("m"), F.col("r"))).collect()
    assert [r[0] for r in rows][:3] == [None, None, 1.0]
    assert [r[1] for r in rows][3:] == [True, False]


def test_snap_legs_and_summary(spark):
    df = spark.createDataFrame([(1000.0, 80.0, 120.0), (2000.0, 80.0, 120.0), (None, 250.0, 250.0)], "g double, c double, f double")
    assert [r[0] for r in df.select(A.with_snaps(F.col("g"), F.col("c"), F.col("f"))).collect()] == [1200.0, 2200.0, None]
    cells = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "nearest_m double")
    row = A.summary(cells).first()
    assert (row["cells_total"], row["cells_reachable"], row["reachable_share"], row["median_nearest_m"], row["p90_nearest_m"]) == (4, 3, 0.75, 2.0, 8.4)


def test_reasons(spark):
    df = spark.createDataFrame(
        [(False, None, 10.0), (False, "Duplicate", 10.0), (True, None, 10.0), (True, None, 600.4), (True, None, 2000.0), (True, None, None)],
        "w boolean, r string, m double",
    )
    got = [r[0] for r in df.select(A.snap_reason(F.col("w"), F.col("r"), F.col("m"))).collect()]
    assert got[:3] == ["Not a public walk-in storefront", "Duplicate", None]
    assert "connected" in got[3] and "600 m" in got[3] and "street" in got[4] and "street" in got[5]
