"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import alignment, curriculum, fertility, licenses, lines, ngram_join, packing, pivots, roles, severity, token_counts, urls, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(operator, table: str):
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, table))


def queries() -> dict:
    return {
        "op1_lexical_packing": _on(packing.op1_lexical_packing, "documents"),
        "op2_tokenizer_fertility": _on(fertility.op2_tokenizer_fertility, "documents"),
        "op3_curriculum_mix": _on(curriculum.op3_curriculum_mix, "documents"),
        "op4_license_scan": _on(licenses.op4_license_scan, "documents"),
        "op5_url_filter": _on(urls.op5_url_filter, "pages"),
        "op6_ordinal_toxicity": lambda spark, sf_dir: severity.op6_ordinal_toxicity(
            _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
        ),
        "op7_ngram_jaccard_join": _on(ngram_join.op7_ngram_jaccard_join, "documents"),
        "op8_pivot_near_dedup": _on(pivots.op8_pivot_near_dedup, "embeddings"),
        "op9_role_repair": _on(roles.op9_role_repair, "conversations"),
        "op10_line_dedup": _on(lines.op10_line_dedup, "documents"),
        "op11_vector_codes": _on(vector_codes.op11_vector_codes, "embeddings"),
        "op12_token_alignment": _on(alignment.op12_token_alignment, "documents"),
        "op13_token_counts": _on(token_counts.op13_token_counts, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_curriculum_mix": curriculum.OP3_SQL,
        "op4_license_scan": licenses.op4_sql(),
        "op5_url_filter": urls.OP5_SQL,
        "op7_ngram_jaccard_join": ngram_join.OP7_SQL,
        "op8_pivot_near_dedup": pivots.OP8_SQL,
        "op10_line_dedup": lines.OP10_SQL,
        "op11_vector_codes": vector_codes.op11_sql(),
    }
