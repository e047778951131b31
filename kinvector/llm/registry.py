"""Names of the numbered queries."""

from __future__ import annotations

from kinvector.llm import queries as q


def queries():
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {name: getattr(q, sql) for name in queries() if hasattr(q, sql := name.split("_")[0].upper())}
