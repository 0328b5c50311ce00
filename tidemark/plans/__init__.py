"""Registered queries: each module maps names to Spark queries and to the SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("windows", "joins", "metrics", "decisions", "rules", "reports", "seasons", "reviews", "transfers", "pages")


def _joined(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), what)
    return found


def queries() -> dict:
    return _joined("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _joined("ORACLE_SQL")
