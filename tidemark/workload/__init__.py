"""The registered queries, grouped by subject, each with the SQL its result is compared with."""

from __future__ import annotations

import importlib

MODULES = (
    "rates", "text", "urls", "extraction", "evidence", "catalogue", "timelines", "matching", "state",
    "notices", "discovery", "jobs", "ingest", "streams",
)


def load() -> dict:
    for name in MODULES:
        importlib.import_module(f"tidemark.workload.{name}")
    from tidemark.workload.registry import REGISTRY

    return REGISTRY
