"""Registered queries: each module maps names to a Spark plan and to equivalent SQL."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if not m.name.startswith("_")]


def queries() -> dict:
    """All (spark, sf_dir) -> DataFrame callables of the plan modules."""
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    """SQL text of those queries that SQL can express."""
    return {name: q for m in _modules() for name, q in m.ORACLES.items()}
