"""Registry of the core queries and the SQL they are checked by."""

from __future__ import annotations

import importlib

#: Modules with queries() and oracle_sql().
MODULES = ("hierarchies", "tables", "graphs", "search", "texts", "work")


def _collect(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"weftline.plans.{name}"), what)())
    return found


def queries() -> dict:
    return _collect("queries")


def oracle_sql() -> dict[str, str]:
    return _collect("oracle_sql")
