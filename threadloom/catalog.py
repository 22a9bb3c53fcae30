"""All graph queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import chains, duplicates, maintenance, nearby, reads, reports, rules, seams, search, stores, threads, traverse, upkeep

MODULES = (reads, search, traverse, threads, maintenance, seams, rules, duplicates, nearby, stores, reports, upkeep, chains)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
