"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from trackfit.llm import chat, exact_dedup, language, packing, quality, sentencepieces, simhash, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": simhash.query,
        "op2_chat_format": chat.query,
        "op3_quality_rules": quality.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_packing": packing.query,
        "op6_sentencepieces": sentencepieces.query,
        "op7_token_counts": token_counts.query,
        "op8_toxicity": toxicity.query,
        "op9_language_id": language.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
    } | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
