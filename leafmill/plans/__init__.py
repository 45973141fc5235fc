"""The registered queries, one module per domain."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = (
    "scans",
    "text",
    "filtering",
    "joining",
    "aggregating",
    "accounting",
    "ranking",
    "retrieving",
    "evaluating",
    "monitoring",
    "rules",
    "graphs",
    "provenance",
    "streams",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"leafmill.plans.{name}")
