"""All queries of the grounding engine."""

from __future__ import annotations

from collections.abc import Callable

from . import document_queries, evaluation, fixture_queries, index_queries, report_queries, surface_queries, table_queries

MODULES = [document_queries, index_queries, fixture_queries, evaluation, report_queries, surface_queries, table_queries]


def queries() -> dict[str, Callable]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
