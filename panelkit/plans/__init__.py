"""Queries over the driver's tables, one per operator, each with independent SQL."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for info in pkgutil.iter_modules(__path__):
        if not info.name.startswith("_"):
            yield importlib.import_module(f"{__name__}.{info.name}")


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
