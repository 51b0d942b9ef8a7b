"""Corpus preparation operators and the queries that apply them to whole tables."""

from __future__ import annotations

import importlib

#: Query name, module, and whether the module has ORACLE, the query's SQL.
_QUERIES = [
    ("op1_quality_rules", "quality_rules", True),
    ("op2_token_counts", "token_counts", False),
    ("op3_language_id", "language_id", False),
    ("op4_suffix_dedup", "suffix_dedup", False),
    ("op5_decontamination", "decontamination", False),
    ("op6_simhash", "simhash", False),
    ("op7_warc", "warc", False),
    ("op8_quality_classifier", "quality_classifier", False),
    ("op9_line_dedup", "line_dedup", False),
    ("op10_bpe_codec", "bpe_codec", False),
    ("op11_license_scan", "license_scan", False),
    ("op12_periodic_runs", "periodic_runs", False),
    ("op13_ranked_search", "lexical_search", True),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__name__}.{module}"), name) for name, module, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"{__name__}.{module}").ORACLE for name, module, has in _QUERIES if has}
