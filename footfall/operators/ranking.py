"""Ranks of a whole table without a task that sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.sources.shared import checkpointed


def whole_rank(df: DataFrame, *order: Column, rank: str = "rank", of: str = "of") -> DataFrame:
    """``df`` with its rows' places, from 1, in an order without ties, and their number.

    Rows are dealt over ranges of the order and numbered within each; the
    numbers of rows of the ranges, one for each partition, then say where a range
    begins. The dealt rows are written, so that both steps see the same ranges.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy("_range").orderBy(*order)
    placed = checkpointed(ranged.withColumn("_place", F.row_number().over(own).cast("long")))
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, begins = 0, []
    for part, n in sizes:
        begins += [F.lit(part), F.lit(before).cast("long")]
        before += n
    start = F.create_map(*begins)[F.col("_range")] if begins else F.lit(0).cast("long")
    return placed.withColumn(rank, start + F.col("_place")).withColumn(of, F.lit(before).cast("long")).drop("_range", "_place")
