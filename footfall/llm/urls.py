"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Every URL is expanded into the expressions a rule could be stored under. Each
is hashed, joined to the rules on the first four bytes of the digest, confirmed
on the whole digest, and the longest rule left decides. Native DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.text import ascii_lower

# The base rules as (verdict, rule).
BASE_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]

PREFIX_HEX = 8


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """rule, verdict and digest from (verdict, rule) pairs."""
    df = spark.createDataFrame(list(rules), "verdict string, rule string")
    return df.select("rule", "verdict", F.sha2("rule", 256).alias("digest"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    default_verdict: str = "allow",
    broadcast_rules: int = 200_000,
    salts: int = 32,
) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``.

    ``rules`` has rule (host and path in one, as ``example.net/en/``), verdict
    and digest. A rule fits its host and all subdomains when the path starts
    with the rule's; the longest rule wins, ties going to block. URLs that no
    rule fits get ``default_verdict``. Null URLs and URLs without ``://`` have
    empty host and path and fit no rule. Repeated rows and null page_ids each
    give a row. Rules are broadcast up to ``broadcast_rules`` rows; beyond, both
    sides are shuffled and the rules copied to ``salts`` partitions, as a hot
    host repeats the same few expressions.
    """
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parsed = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    parsed = parsed.select(
        "page_id",
        F.monotonically_increasing_id().alias("row"),
        ascii_lower(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    rules = rules.where(F.col("rule").isNotNull()).dropDuplicates(["rule", "verdict"])
    shape = rules.select(F.length(F.expr("substring(rule, instr(rule, '/'))")).alias("n")).distinct()
    facts = rules.agg(F.count(F.lit(1)).alias("n")).first()
    lengths = sorted(r["n"] for r in shape.collect())  # at most as many as a path has characters

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.filter(
        F.transform(F.array(*[F.lit(n) for n in lengths or [1]]), lambda n: F.substring("path", F.lit(1), n)),
        lambda p: p != "",
    )
    expressions = F.when(
        F.col("host") != "",
        F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))),
    )
    probes = parsed.select("*", F.explode_outer(expressions).alias("expression")).withColumn(
        "probe", F.sha2("expression", 256)
    )
    keyed = rules.withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    probes = probes.withColumn("key", F.substring("probe", 1, PREFIX_HEX))
    if facts["n"] <= broadcast_rules:
        hits = probes.join(F.broadcast(keyed), "key", "left")
    else:
        copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = probes.withColumn("salt", (F.col("row") % salts).cast("int")).join(copies, ["key", "salt"], "left")
    confirmed = F.when(F.col("digest") == F.col("probe"), F.struct(
        F.length("rule").alias("n"), (F.col("verdict") == "block").alias("blocks"), F.col("rule").alias("rule"),
        F.col("verdict").alias("verdict"),
    ))
    best = hits.groupBy("row").agg(
        F.first("page_id").alias("page_id"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max(confirmed).alias("won"),
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default_verdict)).alias("verdict"),
    )


def op5_url_filter(pages: DataFrame) -> DataFrame:
    """The base rules over every page."""
    return filter_urls(pages, rule_table(pages.sparkSession, BASE_RULES))


OP5_SQL = """
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages)),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) AS k
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN fits ON parsed.r = fits.r AND k = 1
"""
