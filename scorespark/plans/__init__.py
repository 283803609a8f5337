"""Queries over the tables, each with SQL that gives the same rows."""

from __future__ import annotations

import importlib

_MODULES = ("scalars", "joins", "aggregates", "windows", "selection", "sequences", "ordered", "quality", "io", "documents", "streams")
FLAGSHIP = "carry_forward"


def queries() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= importlib.import_module(f"scorespark.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= importlib.import_module(f"scorespark.plans.{name}").SQL
    return out
