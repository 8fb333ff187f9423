"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package so its queries register."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
