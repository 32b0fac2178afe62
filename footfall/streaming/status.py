"""Facility status changes as a stream that keeps a closure table current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.closure import closure_table
from footfall.operators.roster import first_by

CHANGES = "id string, simulatable boolean, changed_at timestamp"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Status changes that arrive as JSON files."""
    return spark.readStream.schema(CHANGES).json(path)


def apply_changes(facilities: DataFrame, changes: DataFrame) -> DataFrame:
    """``facilities`` with the newest status of each that changed."""
    newest = first_by(changes.where(F.col("id").isNotNull()), ["id"], F.desc_nulls_last("changed_at"), F.col("simulatable"))
    new = newest.select("id", F.col("simulatable").alias("_new"))
    return facilities.join(new, "id", "left").select(
        *[F.coalesce("_new", "simulatable").alias(c) if c == "simulatable" else F.col(c) for c in facilities.columns]
    )


def changes_by_window(changes: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """How many facilities opened and closed in each window of event time."""
    return (
        changes.withWatermark("changed_at", late)
        .groupBy(F.window("changed_at", width))
        .agg(F.count_if("simulatable").alias("opened"), F.count_if(~F.col("simulatable")).alias("closed"))
        .select(F.col("window.start").alias("start"), "opened", "closed")
    )


def keep_current(
    changes: DataFrame, cells: DataFrame, facilities: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, mps: float, threshold: float
) -> StreamingQuery:
    """Rewrite the closure table of closable facilities after every batch of changes.

    ``facilities`` reads the table as it is; ``write`` gets the result and the
    batch's number, and writing the same number twice must leave one result.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        now = apply_changes(facilities(), batch)
        able = now.where("in_study_area and simulatable").select("id")
        write(closure_table(cells, mps, threshold).join(able, "id", "left_semi"), number)

    return changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
