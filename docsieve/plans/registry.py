"""All queries of the engine's own operators, and their oracles."""

from __future__ import annotations

from . import card_queries, document_queries, extract_queries, relational_queries, scalar_queries

MODULES = (scalar_queries, relational_queries, document_queries, extract_queries, card_queries)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
