"""The queries that __spark_entry__ registers for this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, licenses, mixing, neighbours, pieces, quality, rules, simhash, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.quality_scores,
        "op2_simhash": simhash.simhash_components,
        "op3_language_id": language.page_languages,
        "op4_sentencepiece": pieces.sentencepieces,
        "op5_toxicity": toxicity.toxicity_scores,
        "op6_quality_rules": rules.quality_rules,
        "op7_substring_dedup": substrings.substring_digest,
        "op8_mixing": mixing.mixed_sources,
        "op9_nearest_neighbours": neighbours.nearest,
        "op10_license_scan": licenses.license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": rules.oracle(), "op10_license_scan": licenses.oracle()}
