"""Operators bound to the bundled tables as named queries, with their SQL."""

from __future__ import annotations

import importlib

from weftline.plans import problems, registry

MODULES = ("scalars", "relations", "rollups", "graphs", "composites", "more", "further")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"weftline.plans.{m}")


def queries() -> dict:
    """All queries of the core library by name."""
    _load()
    return {**problems.QUERIES, **registry.QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    _load()
    return {**problems.SQL, **registry.SQL}
