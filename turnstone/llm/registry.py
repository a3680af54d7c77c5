"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontam, hilbert, mixing, quality, simhash, substring, suffix, tokens, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_near_vectors": vectors.op3_near_vectors,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_quality": quality.op5_quality,
        "op6_ctw_score": ctw.op6_ctw_score,
        "op7_hilbert_shards": hilbert.op7_hilbert_shards,
        "op8_simhash": simhash.op8_simhash,
        "op9_decontaminate": decontam.op9_decontaminate,
        "op10_suffix_dedup": suffix.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say; tests/llm holds the others against brute force."""
    return {
        "op1_substring_dedup": substring.SQL,
        "op3_near_vectors": vectors.SQL,
        "op4_mix_sources": mixing.SQL,
        "op9_decontaminate": decontam.SQL,
        "op10_suffix_dedup": suffix.SQL,
    }
