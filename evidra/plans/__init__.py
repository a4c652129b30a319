"""Registered queries: each module adds its own to ``catalog.QUERIES`` and ``catalog.ORACLE_SQL``."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Imports every module of this package."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
