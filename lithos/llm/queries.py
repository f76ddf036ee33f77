"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import importlib

#: query: (module, SQL in it or None)
QUERIES = {
    "op1_lm_scoring": ("lm_scoring", None),
    "op2_suffix_dedup": ("suffix_dedup", None),
    "op3_embedding_dedup": ("embedding_dedup", None),
    "op4_quality_rules": ("quality_rules", None),
    "op5_quality_classifier": ("kneser_ney", None),
    "op6_simhash": ("simhash", None),
    "op7_mixing": ("mixing", "OP7_SQL"),
    "op8_token_counts": ("token_counts", None),
    "op9_substring_dedup": ("rlz_dedup", None),
    "op10_packing": ("packing", None),
    "op11_filter_audit": ("filter_audit", "OP11_SQL"),
    "op12_sharding": ("sharding", "OP12_SQL"),
    "op13_conversation_repair": ("conversation_repair", None),
}


def queries() -> dict:
    out = {name: getattr(importlib.import_module(f"lithos.llm.{module}"), name) for name, (module, _) in QUERIES.items()}
    import corpus_pipeline

    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"lithos.llm.{module}"), sql) for name, (module, sql) in QUERIES.items() if sql}
