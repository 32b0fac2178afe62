"""Households of block groups on buildings, conserved, and their hexagon cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall import constants as C
from footfall.functions.hexgrid import cell_of
from footfall.functions.text import half_up
from footfall.ship import ship


def is_residential(subtype: Column, klass: Column) -> Column:
    kind, cls = F.lower(F.coalesce(subtype, F.lit(""))), F.lower(F.coalesce(klass, F.lit("")))
    tokens = F.when(kind.isin(*C.UNKNOWN_SUBTYPES), cls).otherwise(F.concat_ws(" ", kind, cls))
    return tokens.rlike("|".join(C.RESIDENTIAL_TOKENS))


def building_weight(footprint: Column, floors: Column, height: Column) -> Column:
    """Footprint times floors; floors from the height where they aren't given."""
    area = F.when((footprint > 0) & ~F.isnan(footprint), footprint).otherwise(C.DEFAULT_FOOTPRINT)
    by_height = F.greatest(height / C.FLOOR_HEIGHT_M, F.lit(1.0))
    levels = F.greatest(F.coalesce(floors.cast("double"), by_height, F.lit(1.0)), F.lit(1.0))
    return area * levels


def numeric(value: Column) -> Column:
    """Numbers written as text; anything else is 0."""
    x = value.cast("string").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(0.0)


def root_sum_square(*values: Column) -> Column:
    return F.sqrt(sum((v * v for v in values[1:]), values[0] * values[0]))


def census_rows(raw: DataFrame, state: str = "25") -> DataFrame:
    """geoid, households, no_vehicle and no_vehicle_moe of a state's block groups."""
    own = raw.where(F.startswith("GEO_ID", F.lit(f"1500000US{state}")))
    col = lambda name: numeric(F.col(name))
    return own.select(
        F.replace("GEO_ID", F.lit("1500000US"), F.lit("")).alias("geoid"),
        col("B25044_E001").alias("households"),
        (col("B25044_E003") + col("B25044_E010")).alias("no_vehicle"),
        root_sum_square(col("B25044_M003"), col("B25044_M010")).alias("no_vehicle_moe"),
    )


def allocate(mapped: DataFrame, block_groups: DataFrame) -> DataFrame:
    """A row per building and block group with its households ``hh``.

    ``mapped`` has id, lat, lon, weight, residential, geoid and city;
    ``block_groups`` geoid, city, lat, lon and no_vehicle. Residential buildings
    are preferred within each block group, and a block group without buildings
    stands for itself, so all households are placed. A geoid with several
    block groups is an error when rows are read.
    """
    group = Window.partitionBy("geoid")
    known = mapped.join(block_groups.select("geoid"), "geoid", "left_semi")
    chosen = known.withColumn("_any", F.bool_or("residential").over(group)).where("residential or not _any").drop("_any")
    bare = block_groups.join(chosen.select("geoid").distinct(), "geoid", "left_anti").select(
        F.concat(F.lit("block-group:"), F.col("geoid").cast("string")).alias("id"),
        "lat",
        "lon",
        F.lit(1.0).alias("weight"),
        F.lit(False).alias("residential"),
        "geoid",
        "city",
    )
    placed = chosen.select("id", "lat", "lon", "weight", "residential", "geoid", "city").unionByName(bare)
    shares = placed.withColumn("_all", F.sum("weight").over(group))
    return (
        shares.join(_one_each(block_groups), "geoid", "left")
        .withColumn("hh", F.col("no_vehicle") * F.col("weight") / F.col("_all"))
        .drop("_all", "no_vehicle")
    )


def _one_each(block_groups: DataFrame) -> DataFrame:
    """geoid and no_vehicle, one row each; several rows of a geoid raise an error."""
    seen = block_groups.groupBy("geoid").agg(F.count(F.lit(1)).alias("n"), F.first("no_vehicle").alias("no_vehicle"))
    several = F.raise_error(F.concat(F.lit("several block groups with geoid "), F.col("geoid").cast("string"))).cast("double")
    return seen.select("geoid", F.when(F.col("n") > 1, several).otherwise(F.col("no_vehicle")).alias("no_vehicle"))


def mass_check(allocated: DataFrame, block_groups: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """allocated, expected and conserved, in one row."""
    got = allocated.agg(F.coalesce(F.sum("hh"), F.lit(0.0)).alias("allocated"))
    want = block_groups.agg(F.coalesce(F.sum("no_vehicle"), F.lit(0.0)).alias("expected"))
    return got.join(want, F.lit(True)).withColumn(
        "conserved", F.abs(F.col("allocated") - F.col("expected")) <= tolerance
    )


def assert_mass(allocated: DataFrame, block_groups: DataFrame, tolerance: float = 0.01) -> None:
    row = mass_check(allocated, block_groups, tolerance).first()
    if not row["conserved"]:
        raise ValueError(f"allocation placed {row['allocated']:.3f} of {row['expected']:.3f} households")


def clip_stats(block_groups: DataFrame) -> DataFrame:
    """How much demand lies in block groups that the study area cuts, in one row."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("clip_ratio", F.lit(1.0))))
    nv, moe = F.coalesce("no_vehicle", F.lit(0.0)), F.coalesce("no_vehicle_moe", F.lit(0.0))
    partial = ratio < C.PARTIAL_CLIP
    sums = block_groups.agg(
        F.count(F.lit(1)).alias("block_groups"),
        F.count_if(partial).alias("partial_clip_block_groups"),
        F.coalesce(F.avg(partial.cast("double")), F.lit(0.0)).alias("partial_clip_share"),
        F.coalesce(F.sum(F.when(partial, nv).otherwise(0.0)), F.lit(0.0)).alias("no_vehicle_in_partial"),
        F.coalesce(F.sum(nv * (1 - ratio)), F.lit(0.0)).alias("outside"),
        F.coalesce(F.sum(nv), F.lit(0.0)).alias("_all"),
        F.coalesce(F.min(ratio), F.lit(1.0)).alias("min_clip_ratio"),
        F.coalesce(F.sqrt(F.sum(moe * moe)), F.lit(0.0)).alias("no_vehicle_moe"),
    )
    return sums.select(
        "block_groups",
        "partial_clip_block_groups",
        half_up(F.col("partial_clip_share"), 4).alias("partial_clip_share"),
        half_up(F.col("no_vehicle_in_partial"), 1).alias("no_vehicle_in_partial"),
        half_up(F.col("outside"), 1).alias("estimated_no_vehicle_outside_by_area"),
        F.coalesce(half_up(F.col("outside") / F.nullif(F.col("_all"), F.lit(0.0)), 4), F.lit(0.0)).alias("estimated_outside_share"),
        half_up(F.col("min_clip_ratio"), 4).alias("min_clip_ratio"),
        half_up(F.col("no_vehicle_moe"), 1).alias("no_vehicle_moe"),
    )


def scale_to_inside(block_groups: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Scale demand by the share inside the study area where it matters.

    That is when more than a hundredth of all demand lies outside; ``scaled``
    says whether it was.
    """
    share = (stats or clip_stats(block_groups)).select("estimated_outside_share")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("clip_ratio", F.lit(1.0))))
    material = F.col("estimated_outside_share") > C.MATERIAL_OUTSIDE
    return (
        block_groups.join(share, F.lit(True))
        .withColumn("no_vehicle", F.when(material, F.col("no_vehicle") * ratio).otherwise(F.col("no_vehicle")))
        .withColumn("no_vehicle_moe", F.when(material, F.col("no_vehicle_moe") * ratio).otherwise(F.col("no_vehicle_moe")))
        .withColumn("scaled", material)
        .drop("estimated_outside_share")
    )


def cells(allocated: DataFrame, cell: Column | None = None) -> DataFrame:
    """Demand cells by (cell, city): no_vehicle, buildings and the mean place.

    The cell is the H3 cell of the place at the published resolution unless
    another is given. A cell that two cities share has a row in each.
    """
    if cell is None:
        ship(allocated.sparkSession)
        cell = cell_of(F.col("lat"), F.col("lon"), C.CELL_RESOLUTION)
        allocated = allocated.withColumn("h3", cell)
        cell = F.col("h3")
    return allocated.groupBy(cell.alias("h3"), "city").agg(
        F.sum("hh").alias("no_vehicle"), F.count("id").alias("buildings"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
