"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query name: module, function, name of its SQL or None
_OPERATORS = {
    "op1_ngram_join": ("ngram_join", "op1", "OP1_SQL"),
    "op2_toxicity": ("toxicity", "op2", None),
    "op3_ann": ("ann", "op3", None),
    "op4_packing": ("packing", "op4", None),
    "op5_html": ("html_extract", "op5", "OP5_SQL"),
    "op6_lm_scoring": ("language_model", "op6", None),
    "op7_quality": ("quality", "op7", None),
    "op8_embedding_dedup": ("embedding_dedup", "op8", "OP8_SQL"),
    "op10_secrets": ("secrets", "op10", None),
    "op9_mixing": ("mixing", "op9", "OP9_SQL"),
    "op11_prefix_trie": ("prefix_trie", "op11", "OP11_SQL"),
    "op12_quality_rules": ("decision_rules", "op12", None),
    "op13_hard_negatives": ("hard_negatives", "op13", "OP13_SQL"),
}


def _load(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    return getattr(importlib.import_module(f"adatlas.llm.{module}"), function)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _load(module, function) for name, (module, function, _) in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _load(module, sql) for name, (module, _, sql) in _OPERATORS.items() if sql}
