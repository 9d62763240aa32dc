"""Registered queries and their DuckDB oracles. `catalog()` gathers every module's entries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from plinth.plans.registry import ENTRIES, Entry

MODULES = [
    "facets", "scalars", "details", "merges", "resolution", "quality", "searching", "ingestion", "extraction", "streams", "enriching",
]


def catalog() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"plinth.plans.{module}")
    return ENTRIES


def runners() -> dict[str, Callable]:
    return {name: entry.run for name, entry in catalog().items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in catalog().items() if entry.sql}
