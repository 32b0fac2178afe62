"""Vector code compression: product codes from weighted Lloyd rounds over distinct parts.

Vectors become integers and are cut into parts. Equal parts of a position are
one row with a weight, so the rounds cost what is distinct, and a crowd of
copies costs one row. Codes and errors of the distinct parts are then joined
back to the vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.spread import each_part, parts_seen, spread_of
from footfall.ship import ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Distinct parts compared with a codebook at once.
STRIP = 4096


def largest_component(width: int) -> int:
    """The largest integer of a component with which squared distances of ``width`` of them fit a long."""
    return min(2**30, math.isqrt((2**63 - 1) // max(1, width)) // 2)


def _nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry, the lower index on ties."""
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), STRIP):
        far = ((parts[at : at + STRIP, None, :] - codebook[None]) ** 2).sum(axis=2)
        code[at : at + STRIP] = best = far.argmin(axis=1)
        error[at : at + STRIP] = far[np.arange(len(best)), best]
    return code, error


def _assigned(batch: pa.RecordBatch, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, parts, codes and errors of a batch of distinct parts."""
    pos = batch.column("pos").to_numpy(zero_copy_only=False)
    parts = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(pos), -1)
    code, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for p in np.unique(pos):
        own = pos == p
        code[own], error[own] = _nearest(parts[own], codebooks[p])
    return pos, parts, code, error


def _round(distinct: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after every distinct part was assigned and entries became weighted means.

    Tasks give sums by position and entry, so what is shuffled and collected is
    as large as the codebooks, whatever the number of vectors.
    """
    n_parts, n_entries, width = codebooks.shape
    names = [f"s{k}" for k in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts * n_entries, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                pos, parts, code, _ = _assigned(batch, codebooks)
                weight = batch.column("weight").to_numpy(zero_copy_only=False)
                np.add.at(total, pos * n_entries + code, np.c_[parts * weight[:, None], weight])
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, total[used].T)], names=["at", *names, "n"])

    schema = ", ".join(f"{c} long" for c in ["at", *names, "n"])
    rows = distinct.select("pos", "part", "weight").mapInArrow(sums, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in [*names, "n"]]).collect()
    out = codebooks.copy().reshape(-1, width)
    for r in rows:
        out[r["at"]] = [r[c] // r["n"] for c in names]
    return out.reshape(codebooks.shape)


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes array<int>, error) of every usable vector, and the codebooks.

    Rows whose ``embedding`` is null or has null or non-finite components are
    dropped. The first remaining vector by id with a length that ``parts``
    divides sets the length; vectors of another length, or with components that
    would overflow (beyond 16,384 times the default scale's unit or more, see
    :func:`largest_component`), stay with null codes and error. Codebooks
    begin with the smallest ids that are not null, ties by their integers; with
    fewer vectors there are fewer entries, without any all codes are null.
    Repeated rows count as often as they stand. An empty table gives an empty
    table. Further columns don't matter.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vector-codes")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & finite)
    first = kept.where(f"size(embedding) > 0 AND size(embedding) % {parts} = 0 AND vec_id IS NOT NULL").select("vec_id", F.size("embedding").alias("n")).orderBy("vec_id", "n").limit(1).collect()
    length = first[0]["n"] if first else 0
    most = largest_component(length)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = (F.size("embedding") == length) & F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < most)
    ints = F.when(usable, F.transform(whole, lambda x: x.cast("int"))) if length else F.lit(None).cast("array<int>")
    # the written row number names a row for good, whatever is computed anew later
    points = scratch.keep(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("ints")), "points")
    seeds = points.where("ints IS NOT NULL AND vec_id IS NOT NULL").orderBy("vec_id", "ints").select("ints").limit(entries).collect()
    width = length // parts
    codebooks = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), parts, width).swapaxes(0, 1).copy()
    if not seeds:
        return points.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), codebooks

    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("ints", p * width + 1, width))
    pieces = points.where("ints IS NOT NULL").select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part")).withColumn("spread", spread_of("row"))
    distinct = scratch.keep(pieces.groupBy("pos", "part").agg(F.count("*").alias("weight"), parts_seen(F.col("spread")).alias("seen")), "distinct")
    for _ in range(rounds):
        codebooks = _round(distinct, codebooks)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, codes, error = _assigned(batch, codebooks)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.astype(np.int32)), pa.array(error)], names=[*batch.schema.names, "code", "error"])

    coded = distinct.drop("weight").mapInArrow(code, "pos int, part array<int>, seen long, code int, error long")
    coded = coded.select("pos", "part", "code", "error", each_part("seen").alias("spread"))
    # a part that a third of all vectors share is met in as many tasks as it has spreads
    found = pieces.join(coded, ["pos", "part", "spread"]).groupBy("row", "vec_id", "label")
    found = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda c: c["code"]).alias("codes"), F.sum("error").alias("error"))
    rest = points.where("ints IS NULL").select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    return found.drop("row").unionByName(rest), codebooks


def approximations(coded: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``approximation``: the vector that its codes stand for, each component in the middle of its integer's range."""
    books = F.lit([[[(x + 0.5) / scale for x in e] for e in book] for book in codebooks.tolist()]).cast("array<array<array<double>>>")
    picked = F.transform("codes", lambda c, p: F.element_at(F.element_at(books, p + 1), c + 1))
    return coded.withColumn("approximation", F.flatten(picked))


def with_label_error(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over equal labels, nulls together; null without any code."""
    coded = scratch.keep(coded.withColumn("spread", spread_of("vec_id", "code")), "coded")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), parts_seen(F.col("spread")).alias("seen"))
    sums = sums.select(F.col("label").alias("own_label"), "label_error", each_part("seen").alias("spread"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("own_label")) & (coded["spread"] == sums["spread"]), "left").drop("own_label", "spread")


def op11_vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept."""
    coded, codebooks = compress(vectors)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    coded = coded.select("vec_id", "label", code.alias("code"), "error")
    out = with_label_error(coded, Scratch(vectors.sparkSession, "vector-codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def op11_sql() -> str:
    """The same rows in DuckDB's SQL, by comparing every part with every entry."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""parts AS MATERIALIZED (
    SELECT vec_id, label, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS part
    FROM kept, range({PARTS}) AS r(p)
)""",
        f"""book0 AS MATERIALIZED (
    SELECT p, e, part FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id, part) - 1 AS e FROM parts) WHERE e < {ENTRIES}
)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (
    SELECT vec_id, label, p, part, min(struct_pack(far := far, e := e)) AS best
    FROM (
        SELECT s.*, b.e, list_sum(list_transform(list_zip(s.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
        FROM parts AS s JOIN book{k} AS b USING (p)
    ) GROUP BY ALL
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(n.part, b.part) AS part
    FROM book{k} AS b LEFT JOIN (
        SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS part
        FROM (
            SELECT p, best.e AS e, i, sum(part[i])::BIGINT AS total, count(*)::BIGINT AS n
            FROM near{k}, range(1, (SELECT max(len(part)) + 1 FROM parts)) AS r(i)
            GROUP BY 1, 2, 3
        ) GROUP BY p, e
    ) AS n USING (p, e)
)"""
            )
    steps.append(
        f"""coded AS (
    SELECT vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error
    FROM near{ROUNDS} GROUP BY vec_id, label
),
digest AS (
    SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
)"""
    )
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, digest"""
    )
