"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: Query name: (module, SQL is there).
_QUERIES = {
    "op1_url_filter": ("url_filter", True),
    "op2_ann_search": ("nearest", False),
    "op3_token_output": ("token_files", False),
    "op4_ngram_join": ("ngram_join", False),
    "op5_quality_rules": ("quality_rules", False),
    "op6_sentencepiece": ("piece_bpe", False),
    "op7_source_mixing": ("mixing", True),
    "op8_language_id": ("language_id", False),
    "op9_line_dedup": ("line_dedup", False),
    "op10_toxicity": ("toxicity", False),
    "op11_page_text": ("page_text", False),
    "op12_row_pattern": ("row_pattern", True),
    "op13_vector_codes": ("vector_codes", True),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"{__package__}.{module}").SQL for name, (module, sql) in _QUERIES.items() if sql}
