"""Line dedup: drop boilerplate lines, keeping them in one document.

Native DataFrame code throughout. Every line long enough gets a 128-bit hash of
its key. Hashes are range-partitioned and sorted within by document and
position, and each range streams its first occurrences. As ranges are of a
hash and a spread of the documents, a line in a third of all documents crosses
ranges: their counts and keepers are added up with map-side combining, so such
a line costs one partial row per task. Decisions go back by hash and spread,
and come out as compressed keep bitmaps per document instead of text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.spread import bit, each_part, parts_seen, spread_of
from footfall.llm.text import ascii_lower, ascii_strip, unused_names

WORD_BITS = 64


def line_table(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points.

    Columns: doc_id, text_hash (with doc_id it names the text), row (a number of
    the row of ``docs``), pos, h1, h2. Null text is one empty line and so gives
    no row.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # before lines are rows
    lines = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    stripped = lines.select("doc_id", "text_hash", "row", "pos", ascii_strip(F.col("line")).alias("key")).where(
        F.char_length("key") >= min_chars
    )
    keyed = stripped.withColumn("key", ascii_lower(F.col("key")))
    return keyed.select(
        "doc_id", "text_hash", "row", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")
    )


def occurrences(lines: DataFrame) -> DataFrame:
    """``lines`` in ranges of h1, h2 and spread, with ``first``: no line of its document comes before it there.

    Ranges are sorted by document, the largest doc_id first, and position. The
    window reads them as they are dealt, without another shuffle.
    """
    dealt = lines.withColumn("spread", spread_of("row")).repartitionByRange("h1", "h2", "spread")
    stream = Window.partitionBy("h1", "h2", "spread").orderBy(F.desc_nulls_last("doc_id"), "row", "pos")
    return dealt.withColumn("first", ~F.col("row").eqNullSafe(F.lag("row").over(stream))).drop("row")


def repeated_keys(found: DataFrame, min_docs: int = 5) -> DataFrame:
    """h1, h2 and spread of :func:`occurrences` in at least ``min_docs`` documents, with their largest doc_id.

    Ranges are summed up in each task, one row per key it holds. A key repeated
    inside one document counts once; each row of the documents counts as one.
    """
    totals = found.groupBy("h1", "h2").agg(
        F.sum(F.col("first").cast("long")).alias("n_docs"),
        F.max("doc_id").alias("keeper"),
        parts_seen(F.col("spread")).alias("seen"),
    )
    return totals.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper", each_part("seen").alias("spread"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Compressed keep bitmaps: doc_id, text_hash, keep map<int,bigint>, n_dropped.

    Bit ``p % 64`` of ``keep[p div 64]`` is 1 when line ``p`` stays. Words whose
    lines all stay are left out, and so are documents that lose no line.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    found = scratch.keep(occurrences(line_table(docs, min_chars)), "occurrences")
    keys = repeated_keys(found, min_docs)
    dropped = found.join(keys, ["h1", "h2", "spread"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = dropped.groupBy(
        "doc_id", "text_hash", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")
    ).agg(F.bit_or(bit(F.col("pos") % WORD_BITS)).alias("gone"))
    maps = words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("gone")).alias("n_dropped"),
    )
    maps = scratch.keep(maps, "bitmaps")
    scratch.drop("occurrences")
    return maps


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``.

    A line's key is the line stripped of ASCII white space and lower-cased in
    A-Z. Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines except those of the largest doc_id holding
    them. Adds n_lines, n_dropped and keep (null when nothing was dropped).
    Null text counts as one empty line and stays null; a null doc_id ranks
    below every other. Repeated rows are documents of their own with the same
    decisions. Columns of ``docs`` with the added names are replaced; all
    others pass through.
    """
    added = ("n_lines", "n_dropped", "keep")
    extra = [c for c in docs.columns if c not in added]
    base = docs.select(*extra)
    own, name = unused_names(base, "own_id", "text_hash")
    maps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    # merged whatever their size: the plan of a small run is that of a large one
    maps = maps.withColumnsRenamed({"doc_id": own, "text_hash": name}).hint("merge")
    joined = base.join(maps, base["doc_id"].eqNullSafe(maps[own]) & (F.xxhash64(base["text"]) == maps[name]), "left")
    lines = F.split("text", "\n", -1)

    def stays(_, p):
        bits = F.try_element_at(F.col("keep"), F.floor(p / WORD_BITS).cast("int"))
        shifted = F.call_function("shiftrightunsigned", bits, (p % WORD_BITS).cast("int"))
        return F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(True))

    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, stays), "\n")
    )
    return joined.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in extra],
        F.when(F.col("text").isNull(), 1).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
    )


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its own columns, boilerplate lines gone and n_chars counted anew.

    A document that loses all its lines is left with empty text.
    """
    out = dedup_lines(docs, **options)
    chars = F.char_length("text").cast("long")
    return out.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def op10_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of ``docs``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP10_SQL = """
WITH lines AS (
  SELECT rowid_, doc_id, p, line, lower_ascii AS key FROM (
    SELECT rowid_, doc_id, p, line,
      translate(trim(line, E' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (
      SELECT rowid_, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p
      FROM (SELECT row_number() OVER () AS rowid_, doc_id,
                   string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))),
keys AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT rowid_) >= 5),
marked AS (
  SELECT l.rowid_, l.doc_id, l.p, l.line,
         k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keeper AS gone
  FROM lines l LEFT JOIN keys k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rowid_, doc_id
"""
