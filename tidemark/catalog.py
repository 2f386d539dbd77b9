"""All registered queries of the signal operators, with the SQL twins."""

from __future__ import annotations

from importlib import import_module

PLANS = ("transforms", "features", "measures", "spectral_pairs", "comparisons")


def queries() -> dict:
    return {name: q for plan in PLANS for name, q in import_module(f"tidemark.plans.{plan}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in import_module(f"tidemark.plans.{plan}").SQL.items()}
