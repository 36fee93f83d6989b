"""Queries of the training-data operators and the SQL that some of them are held against."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_permutation_index": "pivots",
    "op2_line_winnowing": "linededup",
    "op3_toxicity": "toxicity",
    "op4_simhash_golay": "simhash",
    "op5_wavelet_tokens": "tokens",
    "op6_ppm": "ppm",
    "op7_secrets": "secrets",
    "op8_decontamination": "decontam",
    "op9_mixing": "mixing",
    "op10_quality": "quality",
    "op11_license": "licenses",
    "op12_spelling": "spelling",
    "op13_merkle": "manifest",
}


def queries() -> dict:
    return {name: import_module(f"tapeloom.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"tapeloom.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {k: v for k, v in found.items() if v}
