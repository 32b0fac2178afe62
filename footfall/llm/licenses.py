"""License scans: exact containment join of text blocks against templates.

A template matches a block when at least ``threshold`` of the template's
distinct words are in the block. Blocks are overlapping windows over the words
of the whole text, across line breaks; their size follows the template's, so a
template always lies whole in one of them. Candidates come from a prefix index:
template words are put in ascending order of their frequency over all
documents, and a template of m words that needs a of them can only match a
block holding one of its first m - a + 1. Length and positional filters prune
what the index returns, and an intersection decides. Native DataFrame code
throughout.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.text import ascii_lower

# The base phrases and their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Short notices, headers and texts of common public licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", """permission is hereby granted, free of charge, to any person obtaining a copy of this software"""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", "licensed under the apache license version 2"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software. Permission is granted to anyone
        to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("unlicense", "free and unencumbered software released into the public domain"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Least words of a block, and most rows of the prefix index that are broadcast.
LEAST_BLOCK, BROADCAST_ROWS = 16, 200_000


def words(text: Column) -> Column:
    """Words of a text, in order, as they are written."""
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def template_words(text: str) -> list[str]:
    """Words of a template, in order, A-Z lower-cased."""
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


def block_size(template: Sequence[str]) -> int:
    """Words of the blocks for a template: the least power of two that holds it twice."""
    size = LEAST_BLOCK
    while size < 2 * len(template):
        size *= 2
    return size


def template_frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each template word occurs in all of ``docs``.

    The result has one entry per template word, so its size is that of the
    templates; counts are combined in each task before they are shuffled.
    """
    seen = docs.select(F.explode(F.split(F.lower("text"), SEPARATORS)).alias("word"))
    rows = seen.where(F.col("word").isin(list(vocabulary))).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def ordered_templates(
    templates: Sequence[tuple[str, str]], counts: dict[str, int], threshold: float
) -> tuple[list[str], list[tuple]]:
    """Vocabulary rarest first, and (label, words rarest first, needed, block size) per template."""
    whole = [(label, template_words(text)) for label, text in templates]
    order = sorted({w for _, ws in whole for w in ws}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for label, ws in whole:
        toks = sorted(set(ws), key=rank.__getitem__)
        out.append((label, toks, math.ceil(round(threshold * len(toks), 9)), block_size(ws)))
    return order, out


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _starts(ws: Column, phrase: str, label: str) -> Column:
    toks = phrase.split()
    last = F.size(ws) - len(toks)

    def here(i):
        cond = F.get(ws, i) == toks[0]
        for k, t in enumerate(toks[1:], 1):
            cond = cond & (F.get(ws, i + k) == t)
        return cond

    places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    phrases: Sequence[tuple[str, str]] = tuple(BASE_PHRASES),
    threshold: float = 0.9,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, starts, matches.

    ``starts`` lists where a base phrase's words stand consecutively (word index
    and label), ``matches`` the templates found (label, containment, and first
    word and words of the block). Blocks of a template are windows of
    :func:`block_size` words over the whole text, each beginning halfway through
    the one before. Words are taken after A-Z are lower-cased. Null or empty
    text has no words and no match; repeated rows and null doc_ids each give a
    row of their own. Columns of ``docs`` other than doc_id and text are not
    read. The templates' words are counted over all documents first.
    """
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    counts = template_frequencies(docs, vocabulary)
    order, prepared = ordered_templates(templates, counts, threshold)
    rank = {w: i for i, w in enumerate(order)}
    index = [
        (size, rank[tok], pos, label, [rank[t] for t in toks], need)
        for label, toks, need, size in prepared
        for pos, tok in enumerate(toks[: len(toks) - need + 1])
    ]
    prefix = sorted({order[row[1]] for row in index})
    sizes = sorted({row[0] for row in index})
    opening = sorted(set(prefix) | {min(p.split(), key=lambda w: counts.get(w, 0)) for p, _ in phrases})
    index_df = docs.sparkSession.createDataFrame(
        index, "size int, token int, t_pos int, label string, t_words array<int>, need int"
    )
    if len(index) <= BROADCAST_ROWS:
        index_df = F.broadcast(index_df)

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    raw = rows.withColumn("raw", F.split("text", SEPARATORS))
    counted = raw.select(
        "doc_id",
        "row",
        F.coalesce(
            F.size("raw")
            - (F.get("raw", F.lit(0)) == "").cast("int")
            - F.when(F.size("raw") > 1, (F.get("raw", F.size("raw") - 1) == "").cast("int")).otherwise(0),
            F.lit(0),
        )
        .cast("long")
        .alias("n_words"),
        F.when(
            F.arrays_overlap(F.split(F.lower("text"), SEPARATORS), _strings(opening)), ascii_lower(F.col("text"))
        ).alias("text"),
    )
    ws = counted.withColumn("ws", words(F.col("text")))
    met = F.filter(
        F.transform("ws", lambda w, i: F.when(w.isin(prefix), i)), lambda i: i.isNotNull()
    )
    placed = ws.select(
        "doc_id", "row", "n_words", "ws", F.concat(*[_starts(F.col("ws"), p, l) for p, l in phrases]).alias("starts"),
        met.alias("met"),
    )

    def blocks_of(size: int) -> Column:
        """Places of the blocks of this size that hold a word of a prefix."""
        half = size // 2
        last = F.greatest(F.lit(0), F.floor((F.size("ws") - 1) / half) - 1).cast("int")
        of = lambda p: F.floor(p / half).cast("int")
        near = F.array_union(F.transform("met", lambda p: F.least(last, of(p))), F.transform("met", lambda p: of(p) - 1))
        return F.transform(
            F.filter(near, lambda k: k >= 0), lambda k: F.struct(F.lit(size).alias("size"), (k * half).alias("start"))
        )

    places = F.concat(*[blocks_of(size) for size in sizes]) if sizes else F.lit(None).cast("array<struct<size:int,start:int>>")
    blocks = placed.select("doc_id", "row", "n_words", "starts", "ws", F.explode_outer(places).alias("place")).select(
        "doc_id", "row", "n_words", "starts", "place",
        F.filter(F.slice("ws", F.col("place.start") + 1, F.col("place.size")), lambda w: w.isin(order)).alias("known"),
    )
    ranks = F.array_sort(F.transform(F.array_distinct("known"), lambda w: F.array_position(_strings(order or [""]), w).cast("int") - 1))
    known = blocks.select("doc_id", "row", "n_words", "starts", "place", ranks.alias("known"))
    first_ranks = [rank[w] for w in prefix]
    probes = known.select("*", F.explode_outer(F.filter("known", lambda r: r.isin(first_ranks))).alias("token"))
    joined = probes.withColumn("size", F.col("place.size")).join(index_df, ["size", "token"], "left")
    after = F.size(F.filter("known", lambda r: r >= F.col("token")))
    enough = (F.size("known") >= F.col("need")) & (
        F.least(F.size("t_words") - F.col("t_pos"), after) >= F.col("need")
    )
    shared = F.size(F.array_intersect("known", "t_words"))
    share = F.when(enough, F.when(shared >= F.col("need"), shared / F.size("t_words")))
    found = F.when(
        share.isNotNull(),
        F.struct("label", share.alias("containment"), F.col("place.start").alias("first_word"), F.col("place.size").alias("words")),
    )
    return joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("starts").alias("starts"),
        F.collect_set(found).alias("matches"),
    ).select("doc_id", "n_words", "starts", "matches")


def op4_license_scan(docs: DataFrame) -> DataFrame:
    """Base places and labels with the template labels added, one row per document."""
    out = scan_licenses(docs)
    base = F.coalesce(F.transform("starts", lambda s: s["label"]), F.array().cast("array<string>"))
    more = F.transform("matches", lambda m: m["label"])
    places = F.coalesce(F.size("starts"), F.lit(0)).cast("long")
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id",
        "n_words",
        places.alias("n_base"),
        F.array_min(F.transform("starts", lambda s: s["at"])).alias("first_word"),
        F.array_max(F.transform("starts", lambda s: s["at"])).alias("last_word"),
        text_of(base).alias("base_labels"),
        text_of(F.concat(base, more)).alias("labels"),
        F.when(places > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
        .alias("score"),
    )


def op4_sql(threshold: float = 0.9) -> str:
    """DuckDB SQL for :func:`op4_license_scan`: every block against every template of its size."""

    def quoted(words: Sequence[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in BASE_PHRASES)
    _, prepared = ordered_templates(TEMPLATES, {}, threshold)
    templates = ", ".join(f"('{label}', {quoted(toks)}, {need}, {size})" for label, toks, need, size in prepared)
    sizes = ", ".join(f"({size})" for size in sorted({p[3] for p in prepared}))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS ws FROM d),
phrases(words, label) AS (VALUES {phrases}),
templates(label, words, need, size) AS (VALUES {templates}),
sizes(size) AS (VALUES {sizes}),
base AS (SELECT r, i, label FROM (SELECT r, ws, unnest(range(0, len(ws))) AS i FROM w) x, phrases
         WHERE ws[i + 1] = words[1] AND ws[i + 1 : i + len(words)] = words),
b AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, list(DISTINCT label) AS labs FROM base GROUP BY r),
blocks AS (SELECT r, size, unnest(list_transform(range(0, greatest(1, len(ws) - size // 2), size // 2),
             lambda i: list_distinct(ws[i + 1 : i + size]))) AS blk FROM w, sizes WHERE len(ws) > 0),
m AS (SELECT r, label, need, len(list_intersect(blk, words)) AS k, len(words) AS n FROM blocks JOIN templates USING (size)
      WHERE len(blk) >= need),
g AS (SELECT r, list(DISTINCT label) AS labs, max(k::DOUBLE / n) AS best FROM m WHERE k >= need GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f AS first_word, l AS last_word,
  coalesce(array_to_string(list_sort(b.labs), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labs, []), coalesce(g.labs, [])))), ','), '') AS labels,
  (CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END)::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN g USING (r)
"""
