"""Collects the queries and their SQL from the modules that register them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("paperloom.operators.retrieval", "paperloom.operators.grids", "paperloom.plans.table_plan", "paperloom.operators.layout", "paperloom.operators.verification", "paperloom.operators.chunking", "paperloom.operators.repairs", "paperloom.operators.hygiene", "paperloom.operators.evaluation", "paperloom.sources.files", "paperloom.streaming.progress", "paperloom.operators.units", "paperloom.operators.claims", "paperloom.operators.tables_check", "paperloom.operators.pages")


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(name), what)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
