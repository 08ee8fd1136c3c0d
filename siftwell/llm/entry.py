"""The queries of this folder for the driver's entry module, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Module of each query.
_MODULES = {
    "op1_edit_aware_token_counts": "token_counts",
    "op2_html_extraction": "html_text",
    "op3_line_dedup": "line_dedup",
    "op4_benchmark_decontamination": "decontaminate",
    "op5_mixing_sources": "mixing",
    "op6_nearest_neighbours": "neighbours",
    "op7_suffix_array_dedup": "suffixes",
    "op8_quality_classifier": "quality",
    "op9_simhash_near_dedup": "simhash",
    "op10_sharding": "sharding",
    "op11_best_fit_packing": "packing",
    "op12_source_divergence": "divergence",
}


def queries() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
        if name in sql:
            found[name] = sql[name]
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
