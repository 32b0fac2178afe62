"""Reports of the street graph and of sample walks over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import constants as C
from footfall.functions.text import half_up
from footfall.operators import access, network


def error_margins(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rss, n_missing and share by ``keys``: root of the sum of squares, rows without a positive value, and the share of those with one."""
    v = F.col(value)
    found = F.coalesce(v > 0, F.lit(False))
    return df.groupBy(*keys).agg(
        half_up(F.sqrt(F.sum(v * v)), 2).alias("rss"),
        F.count_if(~found).alias("n_missing"),
        half_up(F.avg(found.cast("double")), 4).alias("share"),
    )


def checked_walks(walks: DataFrame) -> DataFrame:
    """Sample walks (name, kind, modeled_m, geodesic_m, reference_m, snap_o_m, snap_d_m) with ratios and whether they are credible.

    Metres are rounded to one place and ratios to three, the verdict is of the
    unrounded ones. ``bridge_ok`` is the guard of walks over bridges, which
    must not be far from the straight line; other walks pass it.
    """
    m, g, r = F.col("modeled_m"), F.col("geodesic_m"), F.col("reference_m")
    far = (F.col("kind") == "bridge") & m.isNotNull() & ~access.within_ratio(m, g, C.GEODESIC_RATIO)
    return walks.select(
        "name",
        "kind",
        *[half_up(F.col(c), 1).alias(c) for c in ("geodesic_m", "modeled_m", "reference_m")],
        half_up(access.walk_ratio(m, r), 3).alias("modeled_over_reference"),
        half_up(access.walk_ratio(m, g), 3).alias("modeled_over_geodesic"),
        *[half_up(F.col(c), 1).alias(c) for c in ("snap_o_m", "snap_d_m")],
        access.plausible(r, g).alias("reference_plausible"),
        access.pair_ok(m, g, r, F.col("kind")).alias("ok"),
        (~far).alias("bridge_ok"),
    )


def validation_summary(checked: DataFrame) -> DataFrame:
    """walks, flagged, bad_bridges, reference_missing and all_pass of :func:`checked_walks` by kind."""
    return checked.groupBy("kind").agg(
        F.count(F.lit(1)).alias("walks"),
        F.count_if(~F.col("ok")).alias("flagged"),
        F.count_if(~F.col("bridge_ok")).alias("bad_bridges"),
        F.count_if(F.col("reference_m").isNull()).alias("reference_missing"),
        F.bool_and("ok").alias("all_pass"),
    )


def assert_bridges(checked: DataFrame) -> None:
    """Raises, with some of their names, where walks over bridges are far from the straight line."""
    bad = [r["name"] for r in checked.where("NOT bridge_ok").select("name").orderBy("name").limit(10).collect()]
    if bad:
        raise ValueError(f"walks over bridges are far from straight: {bad}")


def street_report(nodes: DataFrame, edges: DataFrame, segments: DataFrame, walks: DataFrame, names: dict[str, str]) -> DataFrame:
    """:func:`network.graph_report` with what must hold of a graph that serves, in one row.

    ``segments`` counts those used; ``walks`` (name, o_lat, o_lon, d_lat, d_lon)
    are those that must exist, ``names`` patterns of street names to look for:
    routes, snaps and name_hits hold them by name, and all_pass is the gate of
    the component and of all walks.
    """
    labels = network.components(nodes.select("node"), edges)
    main = nodes.join(network.main_component(labels), "node", "left_semi")
    found = network.routes(walks, main, edges)
    routes = found.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", half_up(F.col("modeled_m"), 1))))).alias("routes_m"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", half_up(F.greatest("snap_o_m", "snap_d_m"), 1))))).alias("snaps_m"),
        F.coalesce(F.bool_and(F.col("modeled_m").isNotNull()), F.lit(True)).alias("connected"),
    )
    hits = []
    for key, pattern in names.items():
        own = network.names_like(segments, pattern).agg(F.array_sort(F.collect_list("name")).alias("n")).select(F.lit(key).alias("key"), "n")
        hits.append(own)
    out = network.graph_report(nodes.select("node"), edges).join(routes, F.lit(True))
    out = out.join(segments.agg(F.count(F.lit(1)).alias("segments")), F.lit(True))
    if hits:
        whole = hits[0]
        for h in hits[1:]:
            whole = whole.union(h)
        out = out.join(whole.agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("name_hits")), F.lit(True))
    return out.withColumn("all_pass", F.col("dominant") & F.col("connected"))
