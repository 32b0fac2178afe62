"""The facility roster: licences, registry, map places and pins, step by step.

Every step is a function of DataFrames. ``ord`` is a row's place in its source
and decides wherever the first of equals counts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall import constants as C
from footfall.functions import text as X
from footfall.functions.geo import haversine_m
from footfall.operators.spatial import within_radius

# Names of the licence export's columns.
LICENSE_COLUMNS = {
    "License Number": "license",
    "License Type": "license_type",
    "License Status": "license_status",
    "Organization Name": "name",
    "Address 1": "address",
    "Address 2": "address2",
    "City": "city",
    "State": "state",
    "Zip Code": "zip",
    "Closure Date": "closure_date",
}
REQUIRED_LICENSE_COLUMNS = ["License Number", "License Status", "Organization Name", "Address 1", "City", "State", "Zip Code"]


def licences(raw: DataFrame) -> DataFrame:
    """The licence export with our names and plain values."""
    missing = sorted(set(REQUIRED_LICENSE_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"licence export lacks columns: {missing}")
    df = raw.withColumnsRenamed(LICENSE_COLUMNS)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.withColumns(
        {
            "address": F.trim(blank("address")),
            "city": F.initcap(blank("city")),
            "zip": F.substring(F.regexp_replace(blank("zip"), r"\D", ""), 1, 5),
            "state": F.upper(F.coalesce("state", F.lit("MA"))),
        }
    )


def not_mail_order(name: Column) -> Column:
    return ~F.coalesce(name, F.lit("")).rlike(C.MAIL_NAME)


def active(df: DataFrame, state: str = "MA") -> DataFrame:
    """Licences in force in the state, without mail-order and institutional names."""
    return df.where(F.col("license_status").isin(*C.ACTIVE_STATUSES) & (F.col("state") == state) & not_mail_order(F.col("name")))


def registry_rows(items: DataFrame, state: str = "MA") -> DataFrame:
    """Retail organisations of the registry, one row per NPI, first seen first.

    ``items`` has number, basic, addresses, other_names and taxonomies as the
    registry's JSON nests them, and ord.
    """
    located = F.filter("addresses", lambda a: a["address_purpose"] == "LOCATION")
    loc = F.coalesce(F.get(located, F.lit(0)), F.get("addresses", F.lit(0)))
    names = F.filter(
        F.transform("other_names", lambda n: n["organization_name"]), lambda n: F.coalesce(n, F.lit("")) != ""
    )
    own = F.filter("taxonomies", lambda t: (t["state"] == state) & (F.coalesce(t["license"], F.lit("")) != ""))
    some = F.filter("taxonomies", lambda t: F.coalesce(t["license"], F.lit("")) != "")
    codes = F.array_sort(F.array_distinct(F.filter(F.transform("taxonomies", lambda t: t["code"]), lambda c: c.isNotNull())))
    rows = items.withColumn("_loc", loc).where(
        (F.upper("_loc.state") == state) & F.coalesce(F.array_contains(codes, C.RETAIL_CODE), F.lit(False))
    )
    out = rows.select(
        F.col("number").cast("string").alias("npi"),
        F.col("basic.organization_name").alias("legal_name"),
        F.coalesce(F.get(names, F.lit(0)), F.col("basic.organization_name")).alias("name"),
        F.concat_ws(" ", F.nullif("_loc.address_1", F.lit("")), F.nullif("_loc.address_2", F.lit(""))).alias("address"),
        F.initcap(F.coalesce("_loc.city", F.lit(""))).alias("city"),
        F.col("_loc.state").alias("state"),
        F.substring(F.coalesce("_loc.postal_code", F.lit("")), 1, 5).alias("zip"),
        F.col("_loc.telephone_number").alias("phone"),
        F.coalesce(F.get(own, F.lit(0))["license"], F.get(some, F.lit(0))["license"]).alias("license"),
        F.array_join(codes, ",").alias("taxonomy_codes"),
        "ord",
    )
    return first_by(out, ["npi"], F.col("ord"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def match_registry(board: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds npi, taxonomy_codes, nppes_lat and nppes_lon by any spelling of the licence.

    Of several hits the least NPI stays; the longer of the two names is kept.
    """
    optional = {c: F.col(c) if c in registry.columns else F.lit(None) for c in ("lat", "lon", "taxonomy_codes")}
    keyed = registry.select(
        F.explode(X.license_keys(F.col("license"))).alias("_key"),
        F.col("npi").cast("string").alias("npi"),
        F.col("name").alias("_name"),
        optional["taxonomy_codes"].cast("string").alias("taxonomy_codes"),
        optional["lat"].cast("double").alias("nppes_lat"),
        optional["lon"].cast("double").alias("nppes_lon"),
        "ord",
    )
    lookup = first_by(keyed, ["_key"], F.col("ord"), F.col("npi")).drop("ord")
    exploded = board.drop("npi", "taxonomy_codes").withColumn("_key", F.explode_outer(X.license_keys(F.col("license"))))
    hits = exploded.join(lookup, "_key", "left")
    best = first_by(hits, ["license"], F.col("npi").asc_nulls_last(), F.col("_key"))
    longer = F.length(F.coalesce("_name", F.lit(""))) > F.length(F.coalesce("name", F.lit("")))
    return best.withColumn("name", F.when(longer, F.col("_name")).otherwise(F.col("name"))).drop("_key", "_name")


def fill_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Take lat and lon from other columns where they are missing and those are not."""
    use = F.col("lat").isNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return df.withColumns(
        {"lat": F.when(use, F.col(lat)).otherwise(F.col("lat")), "lon": F.when(use, F.col(lon)).otherwise(F.col("lon"))}
    )


def facility_places(places: DataFrame) -> DataFrame:
    """Map places that may be facilities, by name and category; columns they lack are null."""
    have = set(places.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    tests = [X.contains_any(col("name"), C.PLACE_NAME_PARTS), X.contains_any(col("category_primary"), C.PLACE_CATEGORY_PARTS)]
    tests += [
        X.contains_any(col(c), C.PLACE_CATEGORY_PARTS[:1])
        for c in ("category_alternate", "taxonomy_primary", "taxonomy_json", "basic_category")
    ]
    conf = F.col("confidence").cast("double") if "confidence" in have else F.lit(None).cast("double")
    order = [F.col("ord")] if "ord" in have else [F.monotonically_increasing_id().alias("ord")]
    return places.where(reduce(or_, tests)).select(
        "id",
        *[col(c).alias(c) for c in ("name", "category_primary", "category_alternate", "taxonomy_primary", "addresses_json")],
        conf.alias("confidence"),
        "lon",
        "lat",
        *order,
    )


def backfill_from_places(board: DataFrame, places: DataFrame) -> DataFrame:
    """lat and lon by a compatible name, the street number and the ZIP in a place's address.

    Joined on the number and ZIP that both sides mention. Places categorised as
    the facility come first, then confidence, then order.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("addresses_json"), F.lit(r"[a-z0-9]+"), F.lit(0)))
    named = places.select(
        F.col("name").alias("p_name"),
        F.lower("addresses_json").alias("p_address"),
        F.col("lat").alias("p_lat"),
        F.col("lon").alias("p_lon"),
        (F.lower(F.coalesce("category_primary", F.lit(""))) == "pharmacy").alias("p_is"),
        F.coalesce("confidence", F.lit(0.0)).alias("p_conf"),
        F.col("ord").alias("p_ord"),
        F.explode(F.filter(tokens, lambda t: t.rlike(r"^\d+$"))).alias("_number"),
    )
    rows = board.withColumn("_row", F.monotonically_increasing_id())
    from footfall.sources.shared import checkpointed

    rows = checkpointed(rows)
    asked = rows.select(
        "_row",
        "name",
        X.street_number(F.col("address")).alias("_number"),
        F.substring(F.regexp_replace(F.coalesce("zip", F.lit("")), r"\D", ""), 1, 5).alias("_zip"),
    ).where(F.col("_number").isNotNull() & (F.col("_zip") != ""))
    hits = asked.join(named, "_number").where(
        F.contains("p_address", F.col("_zip")) & X.same_storefront(F.col("name"), F.col("p_name"))
    )
    best = hits.groupBy("_row").agg(
        F.max(F.struct("p_is", "p_conf", (-F.col("p_ord")).alias("o"), "p_lat", "p_lon")).alias("b")
    )
    return (
        rows.join(best, "_row", "left")
        .withColumns({"lat": F.coalesce("b.p_lat", "lat"), "lon": F.coalesce("b.p_lon", "lon")})
        .drop("_row", "b")
    )


def nearest_compatible_place(board: DataFrame, places: DataFrame, max_m: float = C.PLACE_MATCH_M) -> DataFrame:
    """Adds place_id, place_name, place_m, place_lat and place_lon of the nearest place of a compatible name."""
    targets = places.select(
        F.col("id").alias("place_id"), F.col("name").alias("place_name"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("ord").alias("_o")
    )
    rows = board.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("license", "name", "lat", "lon")
    pairs = within_radius(rows, targets, max_m).where(X.same_storefront(F.col("name"), F.col("place_name")))
    best = pairs.groupBy("license").agg(F.min(F.struct("distance_m", "_o", "place_id", "place_name", "r_lat", "r_lon")).alias("b"))
    return board.join(best, "license", "left").select(
        *board.columns,
        F.col("b.place_id").alias("place_id"),
        F.col("b.place_name").alias("place_name"),
        F.col("b.distance_m").alias("place_m"),
        F.col("b.r_lat").alias("place_lat"),
        F.col("b.r_lon").alias("place_lon"),
    )


def match_registry_near(board: DataFrame, registry: DataFrame, max_m: float = C.REGISTRY_MATCH_M) -> DataFrame:
    """Fills npi and taxonomy_codes from the nearest registry point where npi is missing; the longer name stays."""
    if not {"lat", "lon"} <= set(registry.columns):
        return board
    targets = registry.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("npi").alias("_npi"), F.col("name").alias("_name"), F.col("taxonomy_codes").alias("_codes"),
        F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("ord").alias("_o"),
    )
    rows = board.where(F.col("npi").isNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("license", "lat", "lon")
    best = within_radius(rows, targets, max_m).groupBy("license").agg(
        F.min(F.struct("distance_m", "_o", "_npi", "_name", "_codes")).alias("b")
    )
    longer = F.length(F.coalesce("b._name", F.lit(""))) > F.length(F.coalesce("name", F.lit("")))
    hit = F.col("b").isNotNull()
    return board.join(best, "license", "left").select(
        *[
            {
                "npi": F.when(hit, F.col("b._npi")).otherwise(F.col("npi")),
                "taxonomy_codes": F.when(hit, F.col("b._codes")).otherwise(F.col("taxonomy_codes")),
                "name": F.when(hit & longer, F.col("b._name")).otherwise(F.col("name")),
            }.get(c, F.col(c)).alias(c)
            for c in board.columns
        ]
    )


def refine_by_place(df: DataFrame) -> DataFrame:
    """Move to the place's pin where it is near and its name fits; adds loc_source."""
    use = F.coalesce(
        (F.col("place_m") <= C.PLACE_MATCH_M)
        & F.col("place_lat").isNotNull()
        & F.col("place_lon").isNotNull()
        & X.same_storefront(F.col("name"), F.col("place_name")),
        F.lit(False),
    )
    return df.withColumns(
        {
            "lat": F.when(use, F.col("place_lat")).otherwise(F.col("lat")),
            "lon": F.when(use, F.col("place_lon")).otherwise(F.col("lon")),
            "loc_source": F.when(use, "overture").otherwise("census"),
        }
    )


def cache_key(address: Column, city: Column, zip_code: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", part(address), part(city), part(zip_code))


def with_cached_pin(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds pin_lat, pin_lon and pin_known from a cache (key, lat, lon).

    A key whose coordinates are null is a known miss: pin_known is true.
    """
    c = cache.select("key", F.col("lat").alias("pin_lat"), F.col("lon").alias("pin_lon"), F.lit(True).alias("_hit"))
    c = c.dropDuplicates(["key"])
    keyed = df.withColumn("key", cache_key(F.col("address"), F.col("city"), F.col("zip")))
    return keyed.join(c, "key", "left").withColumn("pin_known", F.coalesce("_hit", F.lit(False))).drop("key", "_hit")


def refine_by_pin(df: DataFrame, inside: Column) -> DataFrame:
    """Move to the cached pin where ``inside`` holds for it and it is trusted.

    Trusted is a pin close by, or one within walking distance of a location
    that isn't a place's or is a place's that was matched from afar.
    """
    away = haversine_m(F.col("lat"), F.col("lon"), F.col("pin_lat"), F.col("pin_lon"))
    weak = (F.col("loc_source") != "overture") | F.coalesce(F.col("place_m") > C.WEAK_PIN_M, F.lit(False))
    trusted = (away <= C.PLACE_MATCH_M) | (weak & (away <= C.TRUSTED_PIN_M))
    use = F.coalesce(F.col("pin_lat").isNotNull() & inside & trusted, F.lit(False))
    return df.withColumns(
        {
            "lat": F.when(use, F.col("pin_lat")).otherwise(F.col("lat")),
            "lon": F.when(use, F.col("pin_lon")).otherwise(F.col("lon")),
            "loc_source": F.when(use, "nominatim").otherwise(F.col("loc_source")),
        }
    )


def confidence(codes: Column, place_id: Column) -> Column:
    retail = F.contains(F.coalesce(codes, F.lit("")), F.lit(C.RETAIL_CODE))
    return F.when(retail, "high").when(place_id.isNotNull(), "medium").otherwise("board")


def mark_duplicates(df: DataFrame, issued: str = "Issue Date") -> DataFrame:
    """Adds duplicate_of: the newest licence of the same storefront, on all its others."""
    identity = X.storefront_identity(F.col("npi"), F.col("name"))
    date = F.coalesce(F.try_to_timestamp(issued), F.try_to_timestamp(issued, F.lit("M/d/yyyy"))) if issued in df.columns else F.lit(None).cast("timestamp")
    keyed = df.withColumn("_id", identity).withColumn("_date", date)
    known = keyed.where(F.col("_id").isNotNull())
    newest = Window.partitionBy("_id").orderBy(F.desc_nulls_last("_date"), "ord")
    marked = known.withColumn("_first", F.first("license").over(newest)).withColumn("_k", F.row_number().over(newest))
    marked = marked.withColumn("duplicate_of", F.when(F.col("_k") > 1, F.col("_first").cast("string")))
    rest = keyed.where(F.col("_id").isNull()).withColumn("duplicate_of", F.lit(None).cast("string"))
    return marked.drop("_first", "_k").unionByName(rest).drop("_id", "_date")


def walk_in(duplicate_of: Column, name: Column, codes: Column, address: Column) -> Column:
    """Whether a licence is a storefront that the public walks into."""
    title = F.coalesce(name, F.lit(""))
    own = X.code_set(codes)
    back_office = (
        F.arrays_overlap(own, F.array(*[F.lit(c) for c in C.OFFICE_CODES]))
        & ~title.rlike(C.CHAIN_NAME)
        & F.coalesce(address, F.lit("")).rlike(C.OFFICE_ADDRESS)
    )
    return (
        F.when(F.coalesce(duplicate_of, F.lit("")) != "", False)
        .when(title.rlike(C.SPECIALTY_NAME), False)
        .when((F.size(own) > 0) & ~F.array_contains(own, C.RETAIL_CODE), False)
        .otherwise(~F.coalesce(back_office, F.lit(False)))
    )


def walk_in_reason(is_walk_in: Column, duplicate_of: Column, name: Column) -> Column:
    # The texts of the reasons.
    return (
        F.when(is_walk_in, None)
        .when(
            F.coalesce(duplicate_of, F.lit("")) != "",
            F.concat(F.lit("Duplicate license for the same storefront; modeled as "), duplicate_of),
        )
        .when(F.coalesce(name, F.lit("")).rlike(C.SPECIALTY_NAME), "Non-storefront pharmacy service")
        .otherwise("Not a public walk-in storefront")
    )


def known_closed(df: DataFrame) -> DataFrame:
    """Rows at addresses where a storefront is known to have closed."""
    city = F.lower(F.coalesce("city", F.lit("")))
    blob = F.lower(F.concat_ws(" ", F.coalesce("address", F.lit("")), F.coalesce("city", F.lit(""))))
    tests = [F.contains(blob, F.lit(s)) & (F.contains(city, F.lit(c)) if c else F.lit(True)) for s, c in C.KNOWN_CLOSED]
    return df.where(reduce(or_, tests))


def assert_none_closed(df: DataFrame) -> None:
    sample = known_closed(df).select("name", "address", "city").limit(5).collect()
    if sample:
        raise ValueError(f"storefronts known to be closed are active: {[r.asDict() for r in sample]}")


def build_roster(
    board: DataFrame, registry: DataFrame, places: DataFrame, geocoded: DataFrame, cache: DataFrame, inside, local_cities: list[str]
) -> DataFrame:
    """All steps in order.

    ``geocoded`` has license, lat and lon of the batch geocoder; ``inside`` maps
    (lat, lon) columns to whether they lie in the envelope.
    """
    rows = match_registry(active(board), registry)
    rows = rows.withColumn("address", X.clean_address(F.col("address"), F.col("address2")))
    rows = rows.drop("lat", "lon").join(geocoded.select("license", "lat", "lon"), "license", "left")
    rows = fill_coordinates(rows, "nppes_lat", "nppes_lon")
    wanting = F.col("lat").isNull() & F.upper("city").isin(*[c.upper() for c in local_cities])
    stays = rows.where(~F.coalesce(wanting, F.lit(False)))
    filled = backfill_from_places(rows.where(wanting), places)
    pinned = with_cached_pin(filled, cache)
    use = F.col("lat").isNull() & F.coalesce(inside(F.col("pin_lat"), F.col("pin_lon")), F.lit(False))
    pinned = pinned.withColumns(
        {"lat": F.when(use, F.col("pin_lat")).otherwise(F.col("lat")), "lon": F.when(use, F.col("pin_lon")).otherwise(F.col("lon"))}
    ).drop("pin_lat", "pin_lon", "pin_known")
    rows = stays.unionByName(pinned.select(*stays.columns))
    rows = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & inside(F.col("lat"), F.col("lon")))
    rows = match_registry_near(rows, registry).where(not_mail_order(F.col("name")))
    rows = refine_by_place(nearest_compatible_place(rows, places))
    rows = refine_by_pin(with_cached_pin(rows, cache), inside(F.col("pin_lat"), F.col("pin_lon")))
    rows = rows.withColumn("confidence", confidence(F.col("taxonomy_codes"), F.col("place_id")))
    rows = mark_duplicates(rows)
    is_in = walk_in(F.col("duplicate_of"), F.col("name"), F.col("taxonomy_codes"), F.col("address"))
    rows = rows.withColumn("walk_in", is_in).withColumn(
        "storefront_reason", walk_in_reason(F.col("walk_in"), F.col("duplicate_of"), F.col("name"))
    )
    assert_none_closed(rows)
    return rows
