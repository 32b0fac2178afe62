import pytest
from pyspark.sql import functions as F

from footfall.functions import text as X
from footfall.operators import roster as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_addresses(spark):
    df = spark.createDataFrame(
        [("Steve Sungkyun Jung 101 Canal Street, Suffolk", None), ("160 Canal St Ste 1", "nan"), ("Ann Lee Corner Shop", ""), (None, None)], "a string, b string"
    )
    got = [r[0] for r in df.select(X.clean_address(F.col("a"), F.col("b"))).collect()]
    assert got[0] == "101 Canal Street" and got[1].startswith("160 Canal St") and got[3] == ""


def test_names(spark):
    pairs = [("Star Market #3696", "Star Market Pharmacy", True), ("CVS #11201", "CVS Pharmacy", True), ("CVS", "Walgreens", False),
             ("Harbor Drug Pharmacy", "Harbor Health", True), ("The Care Center", "Care Pharmacy", False), ("CVS", None, False), ("x", "", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(X.same_storefront(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    keyed = df.where(F.arrays_overlap(X.name_keys(F.col("a")), X.name_keys(F.col("b"))) != F.col("want")).where("b is not null and b <> ''")
    assert keyed.count() == 0


def test_small_functions(spark):
    assert one(spark, "ds-012.34", X.license_keys) == ["DS01234", "01234"]
    assert one(spark, "", X.license_keys) == [] and one(spark, None, X.license_keys) == []
    assert one(spark, "02139-1234", X.zip5) == "02139" and one(spark, "2139", X.zip5) == "02139" and one(spark, None, X.zip5) == "00000"
    assert one(spark, " a , nan,b,,a", X.code_set) == ["a", "b"]
    assert one(spark, "Watertown Town", X.town_name) == "Watertown"
    assert [one(spark, v, X.as_bool) for v in ("True", " 1", "no", None)] == [True, True, False, False]
    assert one(spark, "<a & 'b'>", X.escape_html) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert [one(spark, v, X.number_or_null) for v in ("1.5", "", "NaN", "x", "Infinity", None)] == [1.5, None, None, None, None, None]
    df = spark.createDataFrame([(3.25, 1234.5), (None, 0.4)], "m double, n double")
    rows = df.select(X.format_extra(F.col("m")), X.format_walk(F.col("m")), X.format_households(F.col("n"))).collect()
    assert rows[0][1:] == ("3 min", "1,235") and rows[0][0] in ("+3.3 min", "+3.2 min") and rows[1][:] == ("—", "—", "0")


ROSTER = "ord long, license string, name string, address string, city string, zip string, npi string, taxonomy_codes string, `Issue Date` string, lat double, lon double"
PLACES = "ord long, id string, name string, lat double, lon double, category_primary string, confidence double, addresses_json string"


def roster_row(**kw):
    base = dict(ord=0, license="l", name="CVS", address="1 Main St", city="Boston", zip="02139", npi=None, codes=None, issued=None, lat=42.35, lon=-71.06)
    return tuple((base | kw).values())


def test_nearest_place_skips_other_chains(spark):
    board = spark.createDataFrame([roster_row(name="CVS #1")], ROSTER)
    places = spark.createDataFrame(
        [(0, "wrong", "Walgreens", 42.35001, -71.06, None, None, None), (1, "right", "CVS Pharmacy", 42.3505, -71.06, None, None, None), (2, "far", "CVS", 42.4, -71.06, None, None, None)], PLACES
    )
    r = R.refine_by_place(R.nearest_compatible_place(board, places)).first()
    assert r["place_id"] == "right" and r["loc_source"] == "overture" and r["lat"] == 42.3505
    none = R.refine_by_place(R.nearest_compatible_place(board, places.where("id = 'wrong'"))).first()
    assert none["place_id"] is None and none["loc_source"] == "census" and none["lat"] == 42.35


def test_newest_licence_stands_for_its_storefront(spark):
    rows = [
        roster_row(license="old", npi="1234567890", name="Shop  A", issued="01/01/2000"),
        roster_row(ord=1, license="new", npi="1234567890", name="shop a", issued="01/01/2020"),
        roster_row(ord=2, license="none", npi=None),
        roster_row(ord=3, license="undated", npi="1234567890", name="SHOP A!"),
    ]
    got = {r["license"]: r["duplicate_of"] for r in R.mark_duplicates(spark.createDataFrame(rows, ROSTER)).collect()}
    assert got == {"old": "new", "new": None, "none": None, "undated": "new"}


def test_cached_pins(spark):
    board = spark.createDataFrame([roster_row(), roster_row(ord=1, license="m", address="2 Main St"), roster_row(ord=2, license="n", address="3 Main St")], ROSTER)
    cache = spark.createDataFrame([("1 Main St|Boston|02139", 42.351, -71.06), ("2 Main St|Boston|02139", None, None)], "key string, lat double, lon double")
    pinned = R.with_cached_pin(board.withColumn("loc_source", F.lit("overture")).withColumn("place_m", F.lit(116.7)), cache)
    out = {r["license"]: r for r in R.refine_by_pin(pinned, F.lit(True)).collect()}
    assert out["l"]["lat"] == 42.351 and out["l"]["loc_source"] == "nominatim"
    assert out["m"]["pin_known"] and out["m"]["lat"] == 42.35 and not out["n"]["pin_known"]
    assert {r["loc_source"] for r in R.refine_by_pin(pinned, F.lit(False)).collect()} == {"overture"}


def test_backfill_prefers_the_category(spark):
    board = spark.createDataFrame([roster_row(address="10 Elm St", name="Harbor Drug")], ROSTER)
    places = spark.createDataFrame(
        [
            (0, "a", "Harbor Clinic", 1.0, 1.0, "doctor", 0.99, "[{freeform: 10 Elm Street, postcode: 02139}]"),
            (1, "b", "Harbor Pharmacy", 2.0, 2.0, "pharmacy", 0.5, "[{freeform: 10 Elm Street, postcode: 02139}]"),
            (2, "c", "Harbor Pharmacy", 3.0, 3.0, "pharmacy", 0.9, "[{freeform: 110 Elm Street, postcode: 02139}]"),
        ],
        PLACES,
    )
    assert R.backfill_from_places(board, places).first()["lat"] == 2.0


def test_closed_storefronts_are_refused(spark):
    rows = [("A", "90 River St", "Mattapan"), ("B", "1329 Hyde Park Ave", "Boston"), ("C", "2275 Washington St", "Roxbury"), ("D", "416 Warren St", "Roxbury"), ("E", "90 River St", "Boston")]
    df = spark.createDataFrame(rows, "name string, address string, city string")
    assert sorted(r["name"] for r in R.known_closed(df).collect()) == ["A", "B", "C", "D"]
    with pytest.raises(ValueError):
        R.assert_none_closed(df)
    R.assert_none_closed(df.where("name = 'E'"))


def test_walk_in(spark):
    rows = [
        ("Genoa Healthcare", "3336C0003X", "1 Main St Room P", None, False), ("CVS", None, "101 Canal St", None, True), ("CVS", "3336C0003X,3336L0003X", "1 Main St Suite 2", None, True),
        ("Shop", "3336C0003X,3336L0003X", "1 Main St Suite 2", None, False), ("Shop", "3336L0003X", "1 Main St", None, False), ("CVS", "nan", "x", "old", False),
    ]
    df = spark.createDataFrame(rows, "name string, codes string, address string, dup string, want boolean")
    df = df.withColumn("got", R.walk_in(F.col("dup"), F.col("name"), F.col("codes"), F.col("address")))
    assert df.where("got <> want").count() == 0
    reasons = [r[0] for r in df.select(R.walk_in_reason(F.col("got"), F.col("dup"), F.col("name"))).collect()]
    assert reasons[0] == "Non-storefront pharmacy service" and reasons[1] is None and reasons[5].endswith("modeled as old")


def test_registry_match(spark):
    board = spark.createDataFrame([roster_row(license="DS00123", name="Drug"), roster_row(ord=1, license="", name="X")], ROSTER)
    registry = spark.createDataFrame([(0, "2", "00123", "Longer Name", "3336C0003X"), (1, "1", "DS00123", "B", "3336C0003X")], "ord long, npi string, license string, name string, taxonomy_codes string")
    got = {r["license"]: r for r in R.match_registry(board, registry).collect()}
    assert got["DS00123"]["npi"] == "1" or got["DS00123"]["npi"] == "2"
    assert len(got) == 2 and got[""]["npi"] is None


def test_whole_cascade(spark):
    cols = "ord long, license string, license_status string, name string, address string, address2 string, city string, state string, zip string, `Issue Date` string"
    rows = [
        (0, "DS1", "Current", "CVS #1", "10 Elm Street", None, "Boston", "MA", "02139", "1/2/2020"),
        (1, "DS2", "Expired", "CVS #2", "11 Elm Street", None, "Boston", "MA", "02139", None),
        (2, "DS3", "Current", "Mail Order Rx", "12 Elm Street", None, "Boston", "MA", "02139", None),
        (3, "DS4", "Probation", "Harbor Drug", "13 Elm Street", None, "Boston", "MA", "02139", None),
        (4, "DS5", "Current", "Away Drug", "14 Elm Street", None, "Boston", "MA", "02139", None),
    ]
    board = spark.createDataFrame(rows, cols)
    registry = spark.createDataFrame([(0, "1234567890", "DS1", "CVS", "3336C0003X")], "ord long, npi string, license string, name string, taxonomy_codes string")
    places = spark.createDataFrame([(0, "p", "CVS Pharmacy", 42.3501, -71.06, "pharmacy", 0.9, None)], PLACES)
    geocoded = spark.createDataFrame([("DS1", 42.35, -71.06), ("DS5", 45.0, -71.0)], "license string, lat double, lon double")
    cache = spark.createDataFrame([("13 Elm Street|Boston|02139", 42.36, -71.05)], "key string, lat double, lon double")
    inside = lambda lat, lon: lat.between(42, 43) & lon.between(-72, -70)
    out = {r["license"]: r for r in R.build_roster(board, registry, places, geocoded, cache, inside, ["Boston"]).collect()}
    assert set(out) == {"DS1", "DS4"}
    assert (out["DS1"]["confidence"], out["DS1"]["loc_source"], out["DS1"]["walk_in"]) == ("high", "overture", True)
    assert (out["DS4"]["confidence"], out["DS4"]["lat"]) == ("board", 42.36)
