"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ["tokenize", "split", "leaks", "quality", "boilerplate", "neighbours", "canonical", "names", "scans"]

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"quarto.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= getattr(_m, "ORACLE", {})
