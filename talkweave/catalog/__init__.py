"""Every operator bound to the test tables, next to the SQL that states its result."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ingest", "analytics", "text", "search", "context", "prompts")


def entries() -> dict[str, tuple]:
    """``name -> (callable(spark, folder), sql or None)`` for all catalogued queries."""
    found: dict[str, tuple] = {}
    for name in MODULES:
        found.update(import_module(f"talkweave.catalog.{name}").ENTRIES)
    return found
