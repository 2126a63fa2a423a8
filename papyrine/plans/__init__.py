"""Registered queries and the SQL each is checked with.

A module of this package registers a query with its SQL at once, so neither can be
forgotten; ``None`` stands for a query that SQL cannot state.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("trends", "records", "vocabulary", "matching", "selection", "vectors", "prediction", "extraction", "tools", "streams", "enrichment", "views", "sources")


def _all() -> list[tuple[str, Callable, str | None]]:
    return [row for m in MODULES for row in import_module(f"papyrine.plans.{m}").QUERIES]


def queries() -> dict[str, Callable]:
    return {name: f for name, f, _ in _all()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _all() if sql is not None}
