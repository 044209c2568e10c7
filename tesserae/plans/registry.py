"""All queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import code, decisions, dialect, documents, evidence, ingestion, knowledge, language, lookups, relational, retrieval, strategies, structure

MODULES = (structure, relational, retrieval, decisions, knowledge, ingestion, dialect, language, strategies, lookups, code, evidence, documents)
FLAGSHIP = "retrieve_end_to_end"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
