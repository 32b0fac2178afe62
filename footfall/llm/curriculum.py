"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target by its weight. Its documents, in a fixed hash order,
repeat until the target is met. A weight schedule over training time, once
integrated, says how many of a source's words have been asked for by any time;
inverting it gives the time at which each document's words are, and sorting all
documents by that gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.text import unused_names

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Rate of each weight class at the start and at the end of training, relative
#: to each other; in between it changes linearly.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
LEVEL_BITS = 10


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_order(doc_id: Column, text: Column | None = None) -> Column:
    """60 bits of a digest of id and text, as DuckDB can make them too.

    With the text, rows of one doc_id (or of none) still spread over all places.
    """
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    if text is not None:
        name = F.concat(name, F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, weight_class and target.

    Targets are in proportion to weight and together ``share`` of all sizes; a
    target above ``cap`` times its source's size stops there and the excess is
    dealt out again. Sorted by size for its weight, the capped sources come
    first, so running sums find them. The table has a row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everywhere = Window.partitionBy(F.lit(1))
    ranked = per_source.withColumn(
        "weight_class",
        ((F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)).cast("int"),
    )
    weighted = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("weight_class") + 1)
    )
    upto = everywhere.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = weighted.select(
        "*",
        (share * F.sum("source_size").over(everywhere)).alias("all"),
        F.sum(cap * F.col("source_size")).over(upto).alias("capped"),
        F.sum("weight").over(upto).alias("weight_upto"),
        F.sum("weight").over(everywhere).alias("weight_all"),
    )
    # with this source and all before it capped, what the rest shares for a unit of weight
    own = (F.col("all") - (F.col("capped") - cap * F.col("source_size"))) / (
        F.col("weight_all") - F.col("weight_upto") + F.col("weight")
    )
    is_capped = own * F.col("weight") >= cap * F.col("source_size")
    flagged = sums.withColumn("is_capped", is_capped)
    rest = (
        F.col("all") - F.sum(F.when(F.col("is_capped"), cap * F.col("source_size")).otherwise(0.0)).over(everywhere)
    ) / F.sum(F.when(F.col("is_capped"), 0.0).otherwise(F.col("weight"))).over(everywhere)
    return flagged.select(
        "source",
        "source_size",
        "n_docs",
        "weight_class",
        F.when(F.col("is_capped"), cap * F.col("source_size")).otherwise(rest * F.col("weight")).alias("target"),
    )


def with_words_before(sized: DataFrame, bucket_rows: int = 128) -> DataFrame:
    """``sized`` with ``before``: words of its source that come earlier in hash order.

    A running sum over a source that holds a third of all rows must not run in
    one task. The order key's leading bits cut each source into buckets of some
    ``bucket_rows`` rows; sums of buckets, of groups of 1,024 buckets and so on
    are each run over at most 1,024 rows and added up.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / F.lit(float(bucket_rows))))).cast("int")
    rows = sized.withColumn("bucket", F.call_function("shiftright", "order_key", F.lit(60) - bits))
    rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    inside = Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    level = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("size"))
    offsets = None
    for step in range(3):
        up = F.call_function("shiftright", "bucket", F.lit(LEVEL_BITS))
        run = Window.partitionBy("source_key", up).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        part = level.select(
            "source_key", F.col("bucket").alias(f"b{step}"), F.coalesce(F.sum("size").over(run), F.lit(0)).alias(f"o{step}")
        )
        if offsets is None:
            offsets = part
        else:
            key = F.call_function("shiftright", "b0", F.lit(LEVEL_BITS * step))
            offsets = offsets.withColumn(f"b{step}", key).join(part, ["source_key", f"b{step}"])
        level = level.groupBy("source_key", up.alias("bucket")).agg(F.sum("size").alias("size"))
    added = offsets.select("source_key", F.col("b0").alias("bucket"), (F.col("o0") + F.col("o1") + F.col("o2")).alias("_add"))
    joined = rows.join(added, ["source_key", "bucket"])
    return joined.withColumn("before", F.col("before") + F.col("_add")).drop("_add", "source_key", "bucket")


def words_of(start: Column, size: Column, quota: Column) -> Column:
    """How many of the words [start, start + size) are below ``quota``."""
    return F.greatest(F.lit(0), F.least(size, quota - start))


def time_of(asked: Column, target: Column, weight_class: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Training time in [0, 1] by which a source's demand has reached ``asked`` words.

    A rate that goes from a to b linearly has the integral a t + (b - a) t^2 / 2;
    demand is that over its value at 1, times the target.
    """
    a = F.element_at(F.array(*[F.lit(float(x)) for x, _ in schedule]), weight_class + 1)
    b = F.element_at(F.array(*[F.lit(float(y)) for _, y in schedule]), weight_class + 1)
    area = F.when(target > 0, asked / target).otherwise(0.0) * (a + b) / 2
    slope = b - a
    steep = (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * area)) - a) / slope
    return F.when(F.abs(slope) < 1e-12, area / a).otherwise(steep)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedule: Sequence[tuple[float, float]] = SCHEDULE,
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """The mix, one row per row of ``docs`` (doc_id, text, source).

    Columns: doc_id, text_hash, source, size, source_size, target, taken,
    position, again_position. ``taken`` counts words over both passes: a source
    is read in hash order, from the start again when it ends, until its target
    (to a word) is met, so at most one document of a source is taken in part.
    Positions are the training times of its first and second pass, null for a
    pass it isn't in. Null text has size 0 and is not taken; null sources form
    one source, last in order. Rows with the same doc_id and text share a place
    in the order. An empty table gives no rows.
    """
    sized = Scratch(docs.sparkSession, "mix").keep(docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "source",
        count_words(F.col("text")).alias("size"),
        hash_order(F.col("doc_id"), F.col("text")).alias("order_key"),
    ), "sized")
    targets = source_targets(sized, weights, share, cap)
    lookup = targets.withColumnRenamed("source", "_source")
    # one row per source: broadcast only while that is small, else AQE splits the hot source's partition
    joined = sized.join(lookup, sized["source"].eqNullSafe(lookup["_source"])).drop("_source")
    ordered = with_words_before(joined)
    quota = F.round("target").cast("long")
    first = words_of(F.col("before"), F.col("size"), quota)
    second = words_of(F.col("before") + F.col("source_size"), F.col("size"), quota)
    at = lambda start: time_of(start, F.col("target"), F.col("weight_class"), schedule)
    return ordered.select(
        "doc_id",
        "text_hash",
        "source",
        "size",
        "source_size",
        "target",
        (first + second).alias("taken"),
        F.when(first > 0, at(F.col("before"))).alias("position"),
        F.when(second > 0, at(F.col("before") + F.col("source_size"))).alias("again_position"),
    )


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a mix, one per pass, range-sorted by training time."""
    passes = mixed.select(
        *[c for c in mixed.columns if c not in ("position", "again_position")],
        F.posexplode(F.array("position", "again_position")).alias("pass_no", "position"),
    ).where(F.col("position").isNotNull())
    keys = ("position", "source", "doc_id")
    dealt = passes.repartitionByRange(partitions, *keys) if partitions else passes.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, in training order, with the columns they had.

    A document taken once and a half comes whole and then cut to half its words;
    a document that isn't taken is left out. Rows that agree in doc_id, text and
    source are numbered where the mix takes them unequally, and share what it
    takes of all of them; they have the position of the first. Columns of any
    name pass through.
    """
    names = ("own_id", "own_text", "own_source", "size", "first", "second", "rows", "at_first", "at_second", "rank", "take", "at")
    own_id, own_text, own_source, size, first, second, rows, at_first, at_second, rank, take, at = unused_names(docs, *names)
    col = F.col
    once = F.least("taken", "size")
    mixed = mix(docs, **options).groupBy("doc_id", "text_hash", "source").agg(
        F.max("size").alias(size),
        F.sum(once).alias(first),
        F.sum(col("taken") - once).alias(second),
        F.count(F.lit(1)).alias(rows),
        F.min("position").alias(at_first),
        F.min("again_position").alias(at_second),
    ).where(col(first) > 0)
    mixed = mixed.withColumnsRenamed({"doc_id": own_id, "text_hash": own_text, "source": own_source})
    joined = docs.join(
        mixed,
        docs["doc_id"].eqNullSafe(mixed[own_id]) & (F.xxhash64(docs["text"]) == mixed[own_text])
        & docs["source"].eqNullSafe(mixed[own_source]),
    )
    uneven = (col(first) % (col(size) * col(rows)) != 0) | (col(second) % (col(size) * col(rows)) != 0)
    uneven = uneven & (col(rows) > 1)  # at most where a source's pass ends
    numbered = joined.where(uneven).withColumn(
        rank, F.row_number().over(Window.partitionBy(own_id, own_text, own_source).orderBy(F.lit(0))) - 1
    )
    ranked = joined.where(~uneven).withColumn(rank, F.lit(None).cast("int")).union(numbered)

    def words_taken(total: str) -> Column:
        alike = (col(total) / col(rows)).cast("long")
        return F.when(col(rank).isNull(), alike).otherwise(words_of(col(rank) * col(size), col(size), col(total)))

    passes = F.filter(
        F.array(
            F.struct(col(at_first).alias("at"), words_taken(first).alias("n")),
            F.struct(col(at_second).alias("at"), words_taken(second).alias("n")),
        ),
        lambda p: p["at"].isNotNull() & (p["n"] > 0),
    )
    taken = ranked.select(*docs.columns, size, F.explode(passes).alias(take))
    n = col(take).getField("n")
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")
    taken = taken.withColumn("text", F.when(n < col(size), cut).otherwise(col("text")))
    own = {"n_chars": F.char_length("text").cast("long")}
    out = taken.select(*[own.get(c, col(c)).alias(c) for c in docs.columns], col(take).getField("at").alias(at))
    return out.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").drop(at)


def op3_curriculum_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and position of every document, by position."""
    out = mix(docs).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")
    )
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
      FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(r % 3 + 1)::INT] AS weight FROM s),
u AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
    sum(2.0::DOUBLE * source_size) OVER by_ratio AS capped, sum(weight) OVER by_ratio AS upto, sum(weight) OVER () AS weights
  FROM w WINDOW by_ratio AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (total - (capped - 2.0 * source_size)) / (weights - upto + weight) * weight >= 2.0 * source_size AS full_
      FROM u),
t AS (
  SELECT source, source_size, r, CASE WHEN full_ THEN 2.0::DOUBLE * source_size
    ELSE (total - sum(CASE WHEN full_ THEN 2.0::DOUBLE * source_size ELSE 0 END) OVER ())
         / (sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ()) * weight END AS target
  FROM f),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS quota, t.r,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, greatest(0, least(size, quota - before)) AS first_, greatest(0, least(size, quota - before - source_size)) AS second_,
    [1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE][(r % 3 + 1)::INT] AS a, [0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE][(r % 3 + 1)::INT] AS z
  FROM b),
q AS (SELECT *, CASE WHEN target > 0 THEN before / target ELSE 0 END * (a + z) / 2 AS area FROM p)
SELECT doc_id, size, source_size, target, (first_ + second_)::BIGINT AS taken,
  CASE WHEN first_ > 0 THEN round(CASE WHEN abs(z - a) < 1e-12 THEN area / a
    ELSE (sqrt(greatest(0.0, a * a + 2 * (z - a) * area)) - a) / (z - a) END, 9) + 0.0 END AS position
FROM q
"""
