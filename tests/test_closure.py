import pytest
from pyspark.sql import functions as F

from footfall.functions import text as X
from footfall.operators import closure as C

MPS, LIMIT = 1.34112, 15.0
CELLS = "ord long, h3 string, city string, households double, lat double, lon double, nearest_id string, nearest_m double, second_id string, second_m double"
FACILITIES = "ord long, id string, name string, address string, city string, in_study_area boolean, simulatable boolean"


@pytest.fixture(scope="module")
def facilities(spark):
    rows = [
        (0, "in", "Study CVS", "1 Main St", "Boston", True, True),
        (1, "buf", "Quincy CVS", "2 Main St", "Quincy", False, False),
        (2, "low", "Low Impact", "3 Main St", "Boston", True, True),
    ]
    return spark.createDataFrame(rows, FACILITIES)


def cells(spark, *more):
    rows = [
        (0, "a", "Boston", 10.0, 42.35, -71.07, "in", 400.0, "buf", 1600.0),
        (1, "b", "Boston", 90.0, 42.36, -71.08, "in", 500.0, "buf", 800.0),
        (2, "c", "Boston", 5.0, 42.34, -71.06, "low", 200.0, "in", 400.0),
    ]
    return spark.createDataFrame([*rows, *more], CELLS)


def minutes(m):
    return m / MPS / 60


def test_impact_of_the_fixture(spark, facilities):
    r = C.impact(cells(spark), facilities, "in", MPS, LIMIT).first()
    assert (r["newly_households"], r["kept_households"], r["affected_households"], r["already_households"]) == (10, 90, 100, 0)
    assert r["median_extra"] == 300 and not r["some_unreachable"]
    assert r["median_before_min"] == pytest.approx(minutes(500)) and r["median_after_min"] == pytest.approx(minutes(800))
    assert r["max_after_min"] == pytest.approx(minutes(1600))
    assert r["max_extra_min"] == pytest.approx(minutes(1200))
    assert r["max_before_min"] == pytest.approx(minutes(400))
    first = r["alternatives"][0]
    assert first["alt_id"] == "buf" and first["minutes"] == pytest.approx(minutes(800)) and first["households"] == 100


def test_cells_beyond_the_threshold_change_nothing(spark, facilities):
    far = (3, "d", "Boston", 1.0, 42.3, -71.0, "in", 2000.0, "buf", 5000.0)
    r = C.impact(cells(spark, far), facilities, "in", MPS, LIMIT).first()
    assert r["max_after_min"] == pytest.approx(minutes(1600)) and r["max_before_min"] == pytest.approx(minutes(400))


def test_unreachable_cells(spark, facilities):
    nowhere = spark.createDataFrame([(0, "a", "x", 10.0, 0.0, 0.0, None, None, None, None)], CELLS)
    r = C.impact(nowhere, facilities, None, MPS, LIMIT).first()
    assert r["already_households"] == 10 and r["affected_households"] == 0 and r["median_extra"] is None
    only = spark.createDataFrame([(0, "a", "x", 10.0, 0.0, 0.0, "in", 400.0, None, None)], CELLS)
    r = C.impact(only, facilities, "in", MPS, LIMIT).first()
    assert r["some_unreachable"] and r["newly_households"] == 10 and r["median_extra"] is None


def test_ranks_served_and_example(spark, facilities):
    own = cells(spark)
    served = {r["id"]: r["served_households"] for r in C.served_households(own).collect()}
    assert served == {"in": 100, "low": 5}
    assert C.closure_rank(own, facilities, "in", MPS, LIMIT).first().asDict() == {"rank": 1, "of": 2}
    assert C.closure_rank(own, facilities, "buf", MPS, LIMIT).count() == 0
    assert C.example_closure(own, facilities, MPS, LIMIT).first()["id"] == "in"
    flags = own.select("h3", C.newly_lost(MPS, LIMIT).alias("lost")).collect()
    assert {r["h3"]: r["lost"] for r in flags} == {"a": True, "b": False, "c": False}


def test_search(facilities):
    assert [r["id"] for r in C.search(facilities, "").collect()] == ["in", "low"]
    assert C.search(facilities, "Quincy").count() == 0


def test_weighted_median(spark):
    def median(pairs):
        df = spark.createDataFrame(pairs, "v double, w double")
        row = C.weighted_median_by(df, [], "v", "w", "m").first()
        return row and row["m"]

    assert median([(10.0, 1.0), (100.0, 99.0)]) == 100
    assert median([(400.0, 1.0), (800.0, 1.0)]) == 400
    assert median([(1.0, 0.0), (2.0, -1.0), (float("nan"), 5.0)]) is None


def test_numbers_in_words(spark):
    wanted = {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 41: "41st", 102: "102nd"}
    df = spark.createDataFrame([(k,) for k in wanted], "n long")
    assert {r[0]: r[1] for r in df.select("n", X.ordinal(F.col("n"))).collect()} == wanted
    shares = {(1, 1000): 1, (999, 1000): 99, (0, 1000): 0, (1000, 1000): 100, (5, 0): 0}
    df = spark.createDataFrame(list(shares), "p long, w long")
    assert {(r[0], r[1]): r[2] for r in df.select("p", "w", X.share_percent(F.col("p"), F.col("w"))).collect()} == shares


def test_closure_table_equals_single_impacts(spark, facilities):
    own = cells(spark)
    for r in C.closure_table(own, MPS, LIMIT).collect():
        one = C.impact(own, facilities, r["id"], MPS, LIMIT).first()
        for c in C.IMPACT:
            assert one[c] == r[c]
        assert r["affected_households"] == r["newly_households"] + r["kept_households"]
