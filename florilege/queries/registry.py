"""All queries of the core package with their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("problems", "gcms", "traits", "similarity", "evidence", "providers", "context", "annotations", "selection", "normalized")


def queries() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"florilege.queries.{name}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"florilege.queries.{name}").ORACLES
    return out
