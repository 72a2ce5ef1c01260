"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import importlib

# name of the query -> its module
MODULES = {
    "op1_chat_formatting": "chat_windows",
    "op2_quality_classifier": "cotrain",
    "op3_decontamination": "suffix_decon",
    "op4_ngram_jaccard": "parity_join",
    "op5_warc": "arc_convert",
    "op6_language_id": "langid_viterbi",
    "op7_source_mix": "budget_mix",
    "op8_pii": "pii_weak",
    "op9_line_dedup": "line_bloom",
    "op10_quality_rules": "quality_rules",
}
# name of the query -> the SQL constant of its module
SQL = {
    "op3_decontamination": "OP3_SQL",
    "op4_ngram_jaccard": "OP4_SQL",
    "op5_warc": "OP5_SQL",
    "op9_line_dedup": "OP9_SQL",
    "op10_quality_rules": "OP10_SQL",
}


def _of(name: str, attribute: str):
    return getattr(importlib.import_module(f"{__package__}.{MODULES[name]}"), attribute)


def queries() -> dict:
    return {name: _of(name, name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: _of(name, constant) for name, constant in SQL.items()}
