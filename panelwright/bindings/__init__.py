"""Queries over the test tables, one per operator, with the SQL each must agree with."""

from __future__ import annotations

import importlib

MODULES = ("sources", "scalars", "joining", "aggregating", "describing", "learning", "panels", "scoring")


def load_all():
    from .base import QUERIES

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES
