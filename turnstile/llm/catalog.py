"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import embeddings, fingerprints, html, lm, mixing, neardup, packing, quality, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_lm": lm.op2_lm,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_neardup": neardup.op4_neardup,
        "op5_substring": substring.op5_substring,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_html": html.op7_html,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality": quality.op9_quality,
        "op10_toxicity": toxicity.op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {}
