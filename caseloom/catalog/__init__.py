"""Registered queries over the test tables, each with its SQL equivalent."""

from __future__ import annotations

from importlib import import_module

from caseloom.catalog.registry import ENTRIES, Entry

MODULES = ("sources", "filters", "times", "cases", "encoding", "flow", "mining", "labels", "predict", "scores")


def load() -> dict[str, Entry]:
    for name in MODULES:
        import_module(f"caseloom.catalog.{name}")
    return ENTRIES
