"""What if a facility closes: who loses a walk, who keeps one, who goes where.

``cells`` has a row per demand cell: h3, city, households, nearest_id,
nearest_m, second_id, second_m and ord (artifact order). ``facilities`` has
id, name, address, city, in_study_area, simulatable and ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.constants import DEFAULT_PACE, PACES, THRESHOLD_MINUTES, THRESHOLD_RANGE
from footfall.functions.text import ordinal, share_percent
from footfall.operators.ranking import whole_rank


def minutes(metres: Column, mps: float) -> Column:
    return metres / F.lit(mps) / 60


def with_access(cells: DataFrame, closed_id: str | None, mps: float) -> DataFrame:
    """Adds access_m, access_min and access_id after a closure."""
    closed = F.coalesce(F.col("nearest_id") == F.lit(closed_id), F.lit(False))
    metres = F.when(closed, F.col("second_m")).otherwise(F.col("nearest_m"))
    return cells.select(
        "*",
        metres.alias("access_m"),
        minutes(metres, mps).alias("access_min"),
        F.when(closed, F.col("second_id")).otherwise(F.col("nearest_id")).alias("access_id"),
    )


def reachable(mps: float, threshold: float) -> Column:
    """The nearest facility is within the threshold."""
    return F.coalesce(minutes(F.col("nearest_m"), mps) <= threshold, F.lit(False))


def still_reachable(mps: float, threshold: float) -> Column:
    """The second facility is within the threshold."""
    return F.coalesce(minutes(F.col("second_m"), mps) <= threshold, F.lit(False))


def newly_lost(mps: float, threshold: float) -> Column:
    """The cell loses its walk if its nearest facility closes."""
    return reachable(mps, threshold) & ~still_reachable(mps, threshold)


def weighted_median_by(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Lower weighted median of ``value`` per ``keys``; rows of no weight don't count.

    Equal values are added up first, so the running sum sees distinct values.
    """
    usable = df.where((F.col(weight) > 0) & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    by_value = usable.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    running = F.sum("_w").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = by_value.withColumn("_run", running).withColumn("_all", F.sum("_w").over(part))
    return marked.where(F.col("_run") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias(name))


def newly_lost_by_facility(cells: DataFrame, mps: float, threshold: float) -> DataFrame:
    """id and lost_households of every facility whose closure would cost someone a walk."""
    lost = cells.where(F.col("nearest_id").isNotNull() & newly_lost(mps, threshold))
    return lost.groupBy(F.col("nearest_id").alias("id")).agg(F.sum("households").alias("lost_households"))


def served_households(cells: DataFrame) -> DataFrame:
    """id and households that have it nearest, however far."""
    return cells.where(F.col("nearest_id").isNotNull()).groupBy(F.col("nearest_id").alias("id")).agg(
        F.sum("households").alias("served_households")
    )


def closure_ranks(cells: DataFrame, facilities: DataFrame, mps: float, threshold: float) -> DataFrame:
    """id, lost_households, rank and of, for facilities that can be closed.

    Of equals the id that sorts first in Unicode's order is ahead, so accents
    and case come as in a dictionary; ids that it holds equal go by their bytes.
    """
    lost = newly_lost_by_facility(cells, mps, threshold)
    able = facilities.where("in_study_area and simulatable").select("id")
    scored = able.join(lost, "id", "left").select("id", F.coalesce("lost_households", F.lit(0.0)).alias("lost_households"))
    return whole_rank(scored, F.desc("lost_households"), F.collate("id", "UNICODE").asc(), F.col("id").asc())


def closure_rank(cells: DataFrame, facilities: DataFrame, closed_id: str, mps: float, threshold: float) -> DataFrame:
    """rank and of of one facility; no row where it can't be closed."""
    return closure_ranks(cells, facilities, mps, threshold).where(F.col("id") == closed_id).select("rank", "of")


def example_closure(cells: DataFrame, facilities: DataFrame, mps: float, threshold: float) -> DataFrame:
    """The facility to show first: of most impact, else of the least id."""
    ranked = closure_ranks(cells, facilities, mps, threshold)
    return ranked.orderBy((F.col("lost_households") > 0).desc(), F.desc("lost_households"), "id").limit(1)


def closure_table(cells: DataFrame, mps: float, threshold: float) -> DataFrame:
    """The outcome of closing each facility on its own, one row per nearest_id.

    One pass over the cells for all facilities; medians and the hardest-hit
    cell come from the same rows.
    """
    near, after = reachable(mps, threshold), still_reachable(mps, threshold)
    hit = near & F.col("second_m").isNotNull()
    extra = F.when(hit, F.col("second_m") - F.col("nearest_m"))
    base = cells.where(F.col("nearest_id").isNotNull())
    worst = F.when(hit, F.struct(F.col("second_m"), (-F.col("ord")).alias("first")))
    totals = base.groupBy(F.col("nearest_id").alias("id")).agg(
        F.sum(F.when(near & ~after, F.col("households")).otherwise(0.0)).alias("newly_households"),
        F.sum(F.when(near & after, F.col("households")).otherwise(0.0)).alias("kept_households"),
        F.sum("households").alias("served_households"),
        F.bool_or(near & F.col("second_m").isNull()).alias("some_unreachable"),
        minutes(F.max(extra), mps).alias("max_extra_min"),
        minutes(F.max(F.when(hit, F.col("second_m"))), mps).alias("max_after_min"),
        minutes(F.max_by("nearest_m", worst), mps).alias("max_before_min"),
    )
    rows = base.where(hit).select(
        F.col("nearest_id").alias("id"), "households", "nearest_m", "second_m", (F.col("second_m") - F.col("nearest_m")).alias("extra_m")
    )
    out = totals
    for column, name in (("extra_m", "median_extra"), ("nearest_m", "median_before"), ("second_m", "median_after")):
        out = out.join(weighted_median_by(rows, ["id"], column, "households", name), "id", "left")
    return out.select(
        "id",
        "newly_households",
        "kept_households",
        (F.col("newly_households") + F.col("kept_households")).alias("affected_households"),
        "served_households",
        "some_unreachable",
        "median_extra",
        minutes(F.col("median_extra"), mps).alias("median_extra_min"),
        minutes(F.col("median_before"), mps).alias("median_before_min"),
        minutes(F.col("median_after"), mps).alias("median_after_min"),
        "max_extra_min",
        "max_before_min",
        "max_after_min",
    )


def already_beyond(cells: DataFrame, mps: float, threshold: float) -> DataFrame:
    """Households that have no facility within the threshold, closure or not."""
    beyond = F.when(~reachable(mps, threshold), F.col("households")).otherwise(0.0)
    return cells.agg(F.coalesce(F.sum(beyond), F.lit(0.0)).alias("already_households"))


def alternatives(cells: DataFrame, facilities: DataFrame, mps: float, threshold: float, top: int = 3) -> DataFrame:
    """Where a facility's walkers would go, the ``top`` with most households each.

    Columns: id, alt_id, alt_name (null for an id that isn't a facility's),
    households, minutes and place. Ties go to the alternative met first.
    """
    rows = cells.where(reachable(mps, threshold) & F.col("second_m").isNotNull() & F.col("second_id").isNotNull()).select(
        F.col("nearest_id").alias("id"), F.col("second_id").alias("alt_id"), "households", "second_m", "ord"
    )
    sums = rows.groupBy("id", "alt_id").agg(F.sum("households").alias("households"), F.min("ord").alias("_first"))
    medians = weighted_median_by(rows, ["id", "alt_id"], "second_m", "households", "_m")
    order = Window.partitionBy("id").orderBy(F.desc("households"), "_first")
    ranked = (
        sums.withColumn("place", F.row_number().over(order).cast("long"))
        .where(F.col("place") <= top)
        .join(medians, ["id", "alt_id"], "left")
    )
    names = facilities.select(F.col("id").alias("alt_id"), F.col("name").alias("alt_name"))
    return ranked.join(names, "alt_id", "left").select(
        "id", "alt_id", "alt_name", "households", minutes(F.col("_m"), mps).alias("minutes"), "place"
    )


# Names of an impact's columns, in order.
IMPACT = [
    "newly_households", "kept_households", "affected_households", "some_unreachable", "median_extra",
    "median_extra_min", "median_before_min", "median_after_min", "max_extra_min", "max_before_min", "max_after_min",
]


def impact(cells: DataFrame, facilities: DataFrame, closed_id: str | None, mps: float, threshold: float) -> DataFrame:
    """One row with everything a single closure changes, and its alternatives."""
    own = closure_table(cells.where(F.col("nearest_id") == F.lit(closed_id)), mps, threshold).select(*IMPACT)
    alts = alternatives(cells.where(F.col("nearest_id") == F.lit(closed_id)), facilities, mps, threshold).agg(
        F.array_sort(F.collect_list(F.struct("place", "alt_id", "alt_name", "households", "minutes"))).alias("alternatives")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return (
        already_beyond(cells, mps, threshold)
        .join(own, F.lit(True), "left")
        .join(alts, F.lit(True), "left")
        .select(
            "already_households",
            *[zero(c) if c.endswith("households") else F.coalesce(c, F.lit(False)).alias(c) if c == "some_unreachable" else F.col(c) for c in IMPACT],
            "alternatives",
        )
    )


def panels(cells: DataFrame, facilities: DataFrame, mps: float, threshold: float) -> DataFrame:
    """What a side panel says of each facility that can be closed, a row each.

    id, loss_percent and kept_percent of the affected households, loss_share
    unrounded, alternative_ceiling_min (the threshold, or the longest walk to an
    alternative), rank, of, ordinal and worse_than_percent, the percentage of
    facilities whose closure would cost less.
    """
    changed = closure_table(cells, mps, threshold).select("id", "newly_households", "kept_households", "affected_households")
    longest = alternatives(cells, facilities, mps, threshold).groupBy("id").agg(F.max("minutes").alias("longest"))
    own = closure_ranks(cells, facilities, mps, threshold).join(changed, "id", "left").join(longest, "id", "left")
    part = {c: F.coalesce(f"{c}_households", F.lit(0.0)) for c in ("newly", "kept", "affected")}
    return own.select(
        "id",
        share_percent(part["newly"], part["affected"]).alias("loss_percent"),
        share_percent(part["kept"], part["affected"]).alias("kept_percent"),
        F.coalesce(F.try_divide(part["newly"], part["affected"]) * 100, F.lit(0.0)).alias("loss_share"),
        F.greatest(F.lit(float(threshold)), F.coalesce("longest", F.lit(0.0))).alias("alternative_ceiling_min"),
        "rank",
        "of",
        ordinal(F.col("rank")).alias("ordinal"),
        share_percent(F.col("of") - F.col("rank"), F.col("of")).alias("worse_than_percent"),
    )


def check_threshold(threshold: float) -> float:
    """A threshold in the range that can be chosen."""
    low, high = THRESHOLD_RANGE
    if not low <= threshold <= high:
        raise ValueError(f"a threshold of {threshold} minutes is not between {low} and {high}")
    return float(threshold)


def simulate(cells: DataFrame, facilities: DataFrame, closed_id: str | None, pace: str = DEFAULT_PACE, threshold: float = THRESHOLD_MINUTES) -> DataFrame:
    """:func:`impact` by the name of a pace."""
    return impact(cells, facilities, closed_id, PACES[pace], check_threshold(threshold))


def search(facilities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The first facilities of the study area whose name, address or city holds the query."""
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("address", F.lit("")), F.coalesce("city", F.lit(""))))
    return facilities.where(F.col("in_study_area") & F.contains(text, F.lit(query.strip().lower()))).orderBy("ord").limit(limit)


def facility_counts(facilities: DataFrame) -> DataFrame:
    """facilities, in_area and can_close (in the area and simulatable), in one row."""
    return facilities.agg(
        F.count(F.lit(1)).alias("facilities"),
        F.count_if("in_study_area").alias("in_area"),
        F.count_if(F.col("in_study_area") & F.col("simulatable")).alias("can_close"),
    )


def map_cells(cells: DataFrame, closed_id: str | None, mps: float, threshold: float) -> DataFrame:
    """Cells with status, colour class and opacity for a map."""
    seen = with_access(cells, closed_id, mps)
    simulating = closed_id is not None
    lost = (F.col("nearest_id") == F.lit(closed_id)) & newly_lost(mps, threshold)
    lost = F.coalesce(lost, F.lit(False))
    walk = F.coalesce(F.col("access_min") <= threshold, F.lit(False))
    status = F.when(lost, "Newly lost").when(walk, "Still walkable").otherwise("Too far")
    base = F.least(F.lit(0.62), 0.28 + 0.16 * F.log10(1 + F.col("households")))
    faded = base * 0.28 if simulating else base
    opacity = F.when(lost, base).when(~walk, F.greatest(F.lit(0.4), base * 0.85) if not simulating else faded).otherwise(faded)
    return seen.select("*", status.alias("status") if simulating else F.lit(None).cast("string").alias("status"), opacity.alias("opacity"))


def facility_roles(facilities: DataFrame, closed_id: str | None, alternative_ids: list[str]) -> DataFrame:
    """What each facility is on a map of a scenario."""
    role = (
        F.when(F.col("id") == F.lit(closed_id), "closed")
        .when(F.col("id").isin(*alternative_ids) if alternative_ids else F.lit(False), "alternative")
        .when(~F.col("in_study_area"), "buffer")
        .when(~F.col("simulatable"), "excluded")
        .otherwise("ok")
    )
    return facilities.withColumn("role", role)
