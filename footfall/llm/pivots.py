"""Embedding near-duplicates through a pivot-permutation index.

Pivots are well-separated reference vectors taken from the data, so that a
crowded region has one or few of them. A vector is described by its nearest
pivots in order, and posted in the inverted lists of the first few of them.
Within a list, the whole descriptions of its members make smaller inverted
lists, which count the pivots that two members share; pairs that share enough
are verified by cosine. Long lists are compared in pairs of blocks, and a pair
that meets in several lists counts in one, so links are counted and joined
there, never listed. Exact copies are one vector with a multiplicity throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.components import components
from footfall.llm.scratch import Scratch
from footfall.llm.spread import each_part, parts_seen, spread_of
from footfall.ship import ship

#: Pivots that describe a vector, those among them in whose lists it stands, and
#: how many of the first two vectors must share.
NEAREST, LISTS, SHARED = 12, 6, 3
#: Pivots by number of vectors (twice its root): at least, and at most, so that
#: they are broadcast in 2 ** 17 bytes for each component of a vector.
MIN_PIVOTS, MAX_PIVOTS = 64, 16384
#: Candidates for a pivot, and the cosine to the pivots chosen at which choosing ends.
SAMPLE, SEPARATION = 4, 0.8
#: Members of a list that are compared at once, and rows of their product.
BLOCK, STRIP = 2048, 512
#: Candidates are multiplied pair by pair, so many at a time, where they are fewer than one in this many.
FEW, PAIRS = 32, 4096


def choose_pivots(points: DataFrame, n_points: int) -> dict[int, np.ndarray]:
    """Reference vectors by length: of a sample by digest, always the one farthest from those chosen.

    Their number follows the square root of the number of vectors and ends at
    MAX_PIVOTS, so what is collected and sent out is bounded. Each length in the
    sample has its share of them. Choosing ends earlier where every vector of
    the sample is close to a pivot.
    """
    wanted = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 * np.sqrt(n_points))))
    rows = (
        points.select("v", F.xxhash64(F.lit(17), "v").alias("k"))
        .orderBy("k")
        .limit(SAMPLE * wanted)
        .select("v")
        .collect()
    )
    by_width: dict[int, list] = {}
    for r in rows:
        by_width.setdefault(len(r["v"]), []).append(r["v"])
    return {w: _farthest(unit(np.array(own)), max(1, wanted * len(own) // len(rows))) for w, own in sorted(by_width.items())}


def _farthest(sample: np.ndarray, wanted: int) -> np.ndarray:
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < min(wanted, len(sample)):
        k = int(closest.argmin())
        if closest[k] >= SEPARATION:
            break
        chosen.append(k)
        closest = np.maximum(closest, sample @ sample[k])
    return sample[chosen]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_nearest(points: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """point, label hash and ``near``, the ids of its ``nearest`` pivots, the nearest first.

    Vectors of a length that no pivot has share one list of that length.
    """
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths = batch["v"].map(len).to_numpy()
            near = [np.array([-10 - w], np.int32) for w in widths]
            for w in set(widths.tolist()) & set(pivots):
                own = np.flatnonzero(widths == w)
                cosines = unit(np.array(batch["v"].iloc[own].tolist(), float)) @ pivots[w].T
                order = np.argsort(-cosines, axis=1, kind="stable")[:, :nearest].astype(np.int32) + first[w]
                for k, o in zip(own, order):
                    near[k] = o
            yield pd.DataFrame({"point": batch["point"], "label": batch["label"], "near": near})

    named = points.select("point", F.xxhash64("label").alias("label"), "v")
    return named.mapInPandas(run, "point long, label long, near array<int>")


def shared_counts(near: list[np.ndarray], below: int | None = None) -> np.ndarray:
    """How many pivots two members share, by inverted lists of the pivots (``below`` an id)."""
    counts = np.zeros((len(near), len(near)), np.uint8)
    pivots = np.concatenate(near)
    owner = np.repeat(np.arange(len(near)), [len(n) for n in near])
    if below is not None:
        owner, pivots = owner[pivots < below], pivots[pivots < below]
    order = np.argsort(pivots, kind="stable")
    cuts = np.flatnonzero(np.diff(pivots[order])) + 1
    for rows in np.split(owner[order], cuts):
        if len(rows) > 1:
            counts[rows[:, None], rows] += 1
    return counts


def links_in_lists(
    described: DataFrame, points: DataFrame, threshold: float, shared: int = SHARED, lists: int = LISTS
) -> DataFrame:
    """Links between vectors of one label that share enough pivots, without a list of them.

    A row per vector and pair of blocks it has links in: a, ``b`` (the least
    vector that those links reach) and n, the number of linked vectors counted
    with their copies. A pair is judged in the first list that both stand in.
    """

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        pivot = key[1]
        group = group.sort_values("point", ignore_index=True)
        near = [np.asarray(n, np.int32) for n in group["near"]]
        candidate = shared_counts(near) >= min(shared, *map(len, near))
        candidate &= shared_counts([n[:lists] for n in near], below=pivot) == 0
        block = group["block"].to_numpy()
        if key[2] != key[3]:
            candidate &= block[:, None] != block
        np.fill_diagonal(candidate, False)
        x = unit(np.array(group["v"].tolist(), float))
        linked = np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), STRIP):
            wanted = candidate[at : at + STRIP]
            rows, others = np.nonzero(wanted)
            if len(rows) * FEW > wanted.size:
                cosines = (x[at : at + STRIP] @ x.T)[rows, others]
            else:
                cosines = np.zeros(len(rows))
                for k in range(0, len(rows), PAIRS):
                    part = slice(k, k + PAIRS)
                    cosines[part] = np.einsum("ij,ij->i", x[at + rows[part]], x[others[part]])
            verdict = cosines >= threshold
            for k in np.flatnonzero(np.abs(cosines - threshold) < 1e-12):
                verdict[k] = cosine_of(group["v"][at + rows[k]], group["v"][others[k]]) >= threshold
            linked[at + rows[verdict], others[verdict]] = True
        counts = linked @ group["copies"].to_numpy(np.int64)
        left = counts > 0
        root = np.zeros(len(x), np.int64)
        for k in np.flatnonzero(left):
            if left[k]:
                fresh = np.array([k])
                while len(fresh):
                    left[fresh] = False
                    root[fresh] = k
                    fresh = np.flatnonzero(linked[fresh].any(axis=0) & left)
        some = np.flatnonzero(counts)
        names = group["point"].to_numpy()
        return pd.DataFrame({"a": names[some], "b": names[root[some]], "n": counts[some]})

    posted = described.select("point", "label", F.posexplode(F.slice("near", 1, lists)).alias("rank", "pivot"), spread_of("point").alias("spread"))
    # a list that holds a third of all vectors gets its size in as many tasks as it has spreads
    sizes = posted.groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("size"), parts_seen(F.col("spread")).alias("seen")).where("size > 1")
    sizes = sizes.select("label", "pivot", "size", each_part("seen").alias("spread"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    member = (
        posted.join(sizes, ["label", "pivot", "spread"])
        .select("point", "label", "pivot", blocks.alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    )
    whole = points.select("point", "v", "copies").join(described.select("point", "near"), "point")
    dealt = (
        member.join(whole, "point")
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "with"))
        .withColumn("high", F.greatest("block", "with"))
    )
    return dealt.groupBy("label", "pivot", "low", "high").applyInPandas(compare, "a long, b long, n long")


def cosine_of(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, nearest: int = NEAREST, shared: int = SHARED, lists: int = LISTS
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Vectors link when their labels are equal and their cosine in double
    precision reaches ``threshold``. Null vectors, zero vectors, those with null
    or non-finite components and those with a null label link with nothing.
    Copies of a vector link with each other and share all their links; they are
    counted, not listed. Repeated rows are vectors of their own with the same
    vec_id. A null vec_id links like any other and is no component's name unless
    all of its members have none. Vectors of unequal length never link.
    Candidates share at least ``shared`` of their ``nearest`` pivots, one of them
    among the first ``lists`` of both, in lists without a cap.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pivots")
    rows = with_points(vectors)
    able = rows.where(F.col("point").isNotNull())
    points = able.groupBy("point").agg(
        F.first("label").alias("label"),
        F.first("v").alias("v"),
        F.count(F.lit(1)).alias("copies"),
        F.min("vec_id").alias("least"),
    )
    points = scratch.keep(points, "points")
    pivots = choose_pivots(points, points.count())
    near = scratch.keep(with_nearest(points, pivots, nearest), "near")
    found = scratch.keep(links_in_lists(near, points, threshold, shared, lists), "found")
    groups = components(found.select("a", "b"), scratch, "groups")
    linked = found.groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
    described = (
        points.join(linked, "point", "left")
        .join(groups.withColumnRenamed("node", "point"), "point", "left")
        .withColumn("component", F.coalesce("component", "point"))
    )
    described = scratch.keep(
        described.select(
            "point", "component", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            spread_of("point").alias("spread"),
        ),
        "described",
    )
    named = described.groupBy("component").agg(F.min("least").alias("component_id"), parts_seen(F.col("spread")).alias("seen"))
    named = named.select("component", "component_id", each_part("seen").alias("spread"))
    facts = described.join(named, ["component", "spread"]).select("point", "n_links", "component_id")
    in_groups = able.select("vec_id", "point").join(facts, "point")
    alone = rows.where(F.col("point").isNull()).select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        in_groups.select("vec_id", "n_links", "component_id")
        .union(alone)
        .select(
            "vec_id",
            F.col("n_links").cast("long").alias("n_links"),
            "component_id",
            F.coalesce(F.col("component_id") == F.col("vec_id"), F.col("component_id").isNull()).alias("kept"),
        )
    )


def with_points(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v and point of every row.

    ``point`` names the label and vector by a 64-bit hash; it is null where a
    row can't link. Adding 0.0 makes -0.0 and 0.0 one value, so that copies
    agree in every bit.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = F.forall("v", lambda x: x == 0)
    able = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & ~zero
    return vectors.select("vec_id", "label", v.alias("v")).select(
        "vec_id", "label", "v", F.when(able, F.xxhash64("label", F.lit(3), "v")).alias("point")
    )


def op8_pivot_near_dedup(vectors: DataFrame) -> DataFrame:
    """Links at a cosine of 0.93 or more over all embeddings."""
    return near_vectors(vectors)


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links,
  min(reach.b) AS component_id, v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""
