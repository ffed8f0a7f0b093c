"""Queries of the training-data operators and their SQL.

Operators without SQL (tokenizers, fingerprints, learned models, random splits, rule
tables) are tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provend.llm import (arrow_tokens, chat, collocations, hard_negatives, language_id, license_scan, mixing, packing, quality,
                         revisits, secret_scan, simhash, topk)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": topk.query,
        "op2_secret_scan": secret_scan.query,
        "op3_simhash_near_dedup": simhash.query,
        "op4_token_files": arrow_tokens.query,
        "op5_source_mixing": mixing.query,
        "op6_best_fit_packing": packing.query,
        "op7_license_scan": license_scan.query,
        "op8_quality_rules": quality.query,
        "op9_language_id": language_id.query,
        "op10_revisit_resolution": revisits.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_chat_format": chat.query,
        "op13_collocations": collocations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk.SQL, "op8_quality_rules": quality.SQL, "op10_revisit_resolution": revisits.SQL,
            "op11_hard_negatives": hard_negatives.SQL, "op12_chat_format": chat.SQL,
            "op13_collocations": collocations.SQL}
