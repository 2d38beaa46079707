"""Registered queries of the library's own operators, with their DuckDB equivalents."""

from importlib import import_module

#: Modules with QUERIES and ORACLES.
MODULES = ["plans.graph_queries", "plans.text_queries", "plans.stream_queries"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"fablework.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"fablework.{m}").ORACLES.items()}
