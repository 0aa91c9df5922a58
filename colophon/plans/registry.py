"""Collects the queries of the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("messages", "archive", "search", "text_search", "topics", "ingest", "jobs")
FLAGSHIP = "searched"


def _modules():
    return [import_module(f"colophon.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: function for module in _modules() for name, function in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
