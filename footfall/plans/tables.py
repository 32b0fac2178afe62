"""The engine's inputs as views of general-purpose tables.

embeddings become places on a map: label 0 is the facilities, all others are
demand cells. nation, supplier and customer become block groups, buildings and
people.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.constants import PACES, THRESHOLD_MINUTES
from footfall.functions.text import half_up
from footfall.operators.demand import building_weight
from footfall.operators.spatial import nearest_k
from footfall.sources.shared import checkpointed

MPS = PACES["average"]
THRESHOLD = float(THRESHOLD_MINUTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") / 5
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", (at(0) + -71.1).alias("lon"), (at(1) + 42.35).alias("lat")
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).where("label = 0")
    return own.select(
        F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"),
        F.concat(F.lit("Store "), F.col("vec_id").cast("string")).alias("name"),
        F.concat(F.col("vec_id").cast("string"), F.lit(" Main Street")).alias("address"),
        F.concat(F.lit("City "), (F.col("vec_id") % 7).cast("string")).alias("city"),
        "lat",
        "lon",
        (F.col("vec_id") % 5 != 0).alias("in_study_area"),
        (F.col("vec_id") % 3 != 0).alias("simulatable"),
        F.col("vec_id").alias("ord"),
    )


def demand_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).where("label <> 0")
    return own.select(
        F.col("vec_id").alias("ord"),
        F.col("vec_id").cast("string").alias("h3"),
        F.col("label").cast("string").alias("city"),
        (F.lit(1) + F.col("vec_id") % 17).cast("double").alias("households"),
        "lat",
        "lon",
    )


def access_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the two facilities nearest by great circle, rounded as published."""
    cells = demand_cells(spark, sf_dir)
    targets = facilities(spark, sf_dir).select(F.col("id").alias("target_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = nearest_k(cells.select(F.col("ord").alias("point_id"), "lat", "lon"), targets, k=2, start_m=2000.0)
    two = near.groupBy(F.col("point_id").alias("ord")).agg(
        F.max(F.when(F.col("place") == 1, F.col("target_id"))).alias("nearest_id"),
        half_up(F.max(F.when(F.col("place") == 1, F.col("distance_m"))), 1).alias("nearest_m"),
        F.max(F.when(F.col("place") == 2, F.col("target_id"))).alias("second_id"),
        half_up(F.max(F.when(F.col("place") == 2, F.col("distance_m"))), 1).alias("second_m"),
    )
    # written, as closures read it several times
    return checkpointed(cells.join(two, "ord", "left"))


def block_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation")
    return nation.join(people, nation["n_nationkey"] == people["c_nationkey"], "left").select(
        F.col("n_nationkey").alias("geoid"),
        F.col("n_regionkey").cast("string").alias("city"),
        (F.col("n_nationkey") * 0.01 + 42.0).alias("lat"),
        (F.col("n_nationkey") * 0.01 - 71.0).alias("lon"),
        F.coalesce("n", F.lit(0)).cast("double").alias("no_vehicle"),
        (F.col("n_nationkey") + 1.0).alias("no_vehicle_moe"),
        (1.0 - F.col("n_nationkey") / 50).alias("clip_ratio"),
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with some balance, so that some block groups have none."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 4000")
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"),
        (F.col("s_suppkey") * 0.0001 + 42.0).alias("lat"),
        (F.col("s_suppkey") * 0.0001 - 71.0).alias("lon"),
        building_weight(F.col("s_acctbal"), F.lit(None), (F.col("s_suppkey") % 20).cast("double")).alias("weight"),
        (F.col("s_suppkey") % 3 == 0).alias("residential"),
        F.col("s_nationkey").alias("geoid"),
        F.col("s_nationkey").cast("string").alias("city"),
    )


def graph(spark: SparkSession, sf_dir: str, neighbours: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): places joined to their nearest few by great circle."""
    nodes = points(spark, sf_dir).select(F.col("vec_id").alias("node"), "lat", "lon")
    targets = nodes.select(F.col("node").alias("target_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = nearest_k(nodes.select(F.col("node").alias("point_id"), "lat", "lon"), targets, k=neighbours + 1, start_m=1000.0)
    from footfall.operators.network import undirected

    pairs = near.where("point_id <> target_id").select(
        F.col("point_id").alias("u"), F.col("target_id").alias("v"), half_up(F.col("distance_m"), 1).alias("metres")
    )
    return nodes, undirected(pairs)
