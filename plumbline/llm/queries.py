"""The queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_decontamination": "decontaminate",
    "op10_ngram_jaccard": "near",
    "op11_license_scan": "licenses",
    "op12_merkle_manifest": "merkle",
    "op2_html_extraction": "html_text",
    "op3_exact_dedup": "exact",
    "op4_byte_bpe": "bpe",
    "op5_personal_data": "pii",
    "op6_suffix_array": "substrings",
    "op7_language_id": "language",
    "op8_secrets": "secrets",
    "op9_quality": "quality",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from .exact import OP3_SQL
    from .merkle import OP12_SQL

    return {"op3_exact_dedup": OP3_SQL, "op12_merkle_manifest": OP12_SQL}
