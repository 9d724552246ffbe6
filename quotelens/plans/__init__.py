"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, query

MODULES = (
    "pricing", "compare", "linkage", "units", "text", "history", "extract", "learn", "reports", "ingest", "streams", "analysis",

)

for _name in MODULES:
    importlib.import_module(f"{__name__}.{_name}")
