"""Queries of the corpus operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from importlib import import_module

#: Query name: its module. The query is the module's query(); its SQL, where there is any, is ORACLE_SQL.
MODULES = {
    "op1_pii_surrogates": "pii",
    "op2_simhash_ball": "simhash",
    "op3_kneser_ney_quality": "quality",
    "op4_stratified_interleave": "sharding",
    "op5_qgram_decontaminate": "decontaminate",
    "op6_warc_revisit": "warc",
    "op7_rule_ledger": "rules",
    "op8_wrapper_extract": "wrappers",
    "op9_bm25_packing": "packing",
    "op10_url_template_tree": "urls",
    "op11_best_position_search": "lexical",
    "op12_merkle_manifest": "merkle",
    "op13_secret_markov": "secret_scan",
}


#: Further queries: (module, function, SQL).
FURTHER = {"rules_ablation": ("rules", "ablation_query", "ABLATION_SQL")}


def queries() -> dict:
    found = {name: import_module(f"tidemark.llm.{module}").query for name, module in MODULES.items()}
    return found | {name: getattr(import_module(f"tidemark.llm.{module}"), function) for name, (module, function, _) in FURTHER.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tidemark.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    found |= {name: getattr(import_module(f"tidemark.llm.{module}"), sql) for name, (module, _, sql) in FURTHER.items()}
    return {name: sql for name, sql in found.items() if sql}
