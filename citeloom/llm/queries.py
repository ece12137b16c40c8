"""The queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query name: module that holds a function of that name and perhaps ORACLE_SQL
NAMES = {
    "op1_token_rollup": "rollup",
    "token_rollup_bpe": "rollup",  # the same operator over true token counts, which SQL can't check
    "op2_binary_records": "token_records",
    "op3_ngram_ratio": "quality",
    "op4_link_trust": "url_trust",
    "op5_curriculum_mix": "mixing",
    "op6_setsketch_near_dedup": "neardup",
    "op7_best_fit_packing": "packing",
    "op8_line_neighbourhood": "linededup",
    "op9_hypergeometric_shards": "sharding",
    "op10_pivot_top_k": "topk",
    "op11_run_length_middle": "fim",
    "op12_template_licenses": "licenses",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in NAMES.items() if name.startswith("op")}
    return {name: sql for name, sql in found.items() if sql}
