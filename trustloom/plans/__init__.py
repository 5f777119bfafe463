"""Registered queries over the provided tables and their reference SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("series_queries", "rule_queries", "graph_queries", "telemetry_queries", "host_queries", "intent_queries", "recommend_queries",
           "knowledge_queries", "stream_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"trustloom.plans.{module}"), name)
        double = out.keys() & part.keys()
        if double:
            raise ValueError(f"registered twice: {sorted(double)}")
        out.update(part)
    return out


def registered_queries() -> dict:
    return _merged("QUERIES")


def reference_sql() -> dict[str, str]:
    return _merged("ORACLE")
