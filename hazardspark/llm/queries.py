"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module; each module has ``query(spark, sf_dir)`` and may have ``ORACLE_SQL``.
MODULES = {
    "op1_document_fingerprints": "fingerprints",
    "op2_exact_topk_search": "topk",
    "op3_byte_bpe": "byte_bpe",
    "op4_chat_perspectives": "chat",
    "op5_ngram_jaccard_join": "jaccard",
    "op6_warc": "warc",
    "op7_quality_classifier": "quality",
    "op8_lm_scoring": "lm",
    "op9_best_fit_packing": "packing",
    "op10_suffix_dedup": "suffixes",
    "op11_merkle_manifest": "merkle",
    "op12_language_id": "langid",
    "op13_hard_negatives": "covertree",
}


def _modules() -> dict:
    return {name: import_module(f"hazardspark.llm.{module}") for name, module in MODULES.items()}


def queries() -> dict:
    return {name: module.query for name, module in _modules().items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _modules().items() if getattr(module, "ORACLE_SQL", None)}
