"""Registered queries of the package: one thin query for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import bpe, decontaminate, html_text, jaccard_join, language_id, line_dedup, periodic_runs, pii, quality, shards, simhash, spelling, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.query,
    "op2_decontaminate": decontaminate.query,
    "op3_html_text": html_text.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_bpe": bpe.query,
    "op6_quality_rules": quality.query,
    "op7_language_id": language_id.query,
    "op8_pii_surrogates": pii.query,
    "op9_kk_shards": shards.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_simhash": simhash.query,
    "op12_spelling_variants": spelling.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE: dict[str, str] = {"op6_quality_rules": quality.ORACLE, "op12_spelling_variants": spelling.ORACLE}
