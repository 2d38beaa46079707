"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ["url_filter", "token_file", "neighbours", "toxicity", "mixing", "quality_rules", "chat_format", "byte_bpe", "token_counts", "near_dedup",
           "interval_join", "substring_dedup", "filter_audit"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLES.items()}
