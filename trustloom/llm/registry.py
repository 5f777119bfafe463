"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("additive", "codes", "exact", "forest", "lexical", "lines", "mixing", "near", "packing", "search", "secrets", "sharding", "substrings")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(import_module(f"trustloom.llm.{module}"), name))
    return out


def llm_queries() -> dict:
    return _merged("QUERIES")


def llm_sql() -> dict[str, str]:
    return _merged("ORACLE")
