"""The catalogue of core queries: name -> callable, and name -> SQL."""

from __future__ import annotations

from .plans import q_dataset, q_rating, q_reconcile, q_records, q_text

MODULES = [q_records, q_reconcile, q_rating, q_text, q_dataset]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
