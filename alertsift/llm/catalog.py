"""Registry of this folder's queries and of the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MODULES = ("quality_query", "bpe_query", "toxicity_query", "urls_query", "minhash_query", "chat_query", "vectors_query", "packing_query", "pii_query", "licenses_query", "mixing_query", "negatives_query", "repair_query")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")
