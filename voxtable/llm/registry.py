"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxtable.llm import chat_format, decontamination, language_id, ngram_join, packing, quality_rules, sharding, substring_dedup, token_output, warc

MODULES = {
    "op1_sharding": sharding,
    "op2_chat_format": chat_format,
    "op3_language_id": language_id,
    "op4_warc": warc,
    "op5_substring_dedup": substring_dedup,
    "op6_ngram_join": ngram_join,
    "op7_decontamination": decontamination,
    "op8_token_output": token_output,
    "op9_packing": packing,
    "op10_quality_rules": quality_rules,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in MODULES.items()} | {"quality_ablation": quality_rules.ablation_query}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)} | {"quality_ablation": quality_rules.ABLATION_SQL}
