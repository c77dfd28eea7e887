"""Queries of this subpackage and the SQL that the driver compares them with."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = (
    "paperloom.llm.neighbours",
    "paperloom.llm.near_copies",
    "paperloom.llm.markup",
    "paperloom.llm.distinctive",
    "paperloom.llm.answers",
    "paperloom.llm.scans",
    "paperloom.llm.encoding",
    "paperloom.llm.mixing",
    "paperloom.llm.repetition",
)


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(name), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
