"""Registered queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``q_*`` module so that its queries are registered."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"{__name__}.{module}")
