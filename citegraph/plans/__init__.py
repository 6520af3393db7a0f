"""Test tables seen as catalog tables, and the registered queries with their SQL."""

from __future__ import annotations

from importlib import import_module

from citegraph.plans.registry import Registry

MODULES = (
    "queries_sources", "queries_identity", "queries_catalog", "queries_graph", "queries_pages", "queries_notes",
    "queries_stores", "queries_streaming",
)


def all_queries() -> Registry:
    registry = Registry()
    for name in MODULES:
        registry.include(import_module(f"citegraph.plans.{name}").REG)
    return registry
