"""All queries by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("events", "customers", "metrics", "records", "representations")


def load() -> tuple[dict, dict]:
    """Queries and check statements."""
    for name in MODULES:
        import_module(f"buyerlens.registry.{name}")
    base = import_module("buyerlens.registry.base")
    return dict(base.QUERIES), dict(base.ORACLE)
