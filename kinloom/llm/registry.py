"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, chat_snapshots, embedding_dedup, language_id, license_scan, ngram_jaccard, pii_crf, quality_rules, secret_scan, source_mixing

Query = Callable[[SparkSession, str], DataFrame]

OPERATORS = {
    "op1_pii_crf": pii_crf,
    "op2_language_id": language_id,
    "op3_source_mixing": source_mixing,
    "op4_chat_snapshots": chat_snapshots,
    "op5_secret_scan": secret_scan,
    "op6_license_scan": license_scan,
    "op7_quality_rules": quality_rules,
    "op8_ngram_jaccard": ngram_jaccard,
    "op9_bpe_codec": bpe_codec,
    "op10_embedding_dedup": embedding_dedup,
}


def queries() -> dict[str, Query]:
    return {name: m.query for name, m in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in OPERATORS.items() if getattr(m, "ORACLE", None)}
