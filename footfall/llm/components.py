"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.spread import each_part, parts_seen, spread_of

MAX_ROUNDS = 60
#: Up to so many links, the least neighbours are broadcast instead of shuffling the links to them.
BROADCAST_LINKS = 200_000


def with_least(edges: DataFrame, few: bool = False) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least v of each u, dealt so that no u fills a task.

    ``few`` says that a counted bound lets the least neighbours be broadcast.
    """
    if few:
        return edges.join(F.broadcast(edges.groupBy("u").agg(F.min("v").alias("m"))), "u")
    dealt = edges.withColumn("spread", spread_of("v"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), parts_seen(F.col("spread")).alias("seen"))
    return dealt.join(least.select("u", "m", each_part("seen").alias("spread")), ["u", "spread"]).drop("spread")


def unsettled(edges: DataFrame) -> DataFrame:
    """Nodes of distinct ``edges`` (u, v) that point at several others, or at one and are pointed at."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.where("below > 1 or (below > 0 and above > 0)")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (its smallest node) for every node of ``links`` (a, b).

    Alternates between pointing every node at the smallest node it knows and
    its larger neighbours at that one too, so chains halve in each round, and
    writes every round's links, so a lost executor costs one round at most.
    A node of very many links is combined in each task before it is shuffled,
    and its links are dealt over parts.
    """
    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{name}-0",
    )
    few = edges.count() <= BROADCAST_LINKS  # rounds never make more links than there were
    for step in range(1, MAX_ROUNDS):
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = edges.union(edges.select("v", "u"))
        large = with_least(both, few).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: smaller neighbours of u, and u, go to the least of them
        low = with_least(large.where("u <> v"), few)
        small = low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.distinct()
        new = scratch.keep(small, f"{name}-{step}")
        done = unsettled(new).isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        edges = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def merged(groups: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``groups`` (node, component), a written table, after further ``links`` (a, b), another one.

    Only links between different components are solved, as a graph of
    components, so what was found before is not walked through again.
    """
    at = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    to = groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = links.select("a", "b").join(at, "a", "left").join(to, "b", "left")
    ends = scratch.keep(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), f"{name}-ends")
    between = ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    renamed = scratch.keep(components(between, scratch, name), f"{name}-renamed")
    alone = ends.select("a", "ca").union(ends.select("b", "cb")).where("a = ca").select(F.col("a").alias("node")).distinct()
    alone = alone.join(groups, "node", "left_anti").select("node", F.col("node").alias("component"))
    new = renamed.select(F.col("node").alias("component"), F.col("component").alias("root"))
    out = groups.union(alone).join(new, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    out = scratch.keep(out, f"{name}-groups")
    scratch.drop(f"{name}-ends")
    scratch.drop(f"{name}-renamed")
    return out
