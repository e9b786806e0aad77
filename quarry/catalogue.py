"""Queries of the engine's operators and their SQL twins."""

from __future__ import annotations

import importlib

from quarry.plans.registry import ORACLE_SQL, QUERIES

for _module in ("texts", "knowledge", "dialogue", "evaluation", "jobs"):
    importlib.import_module(f"quarry.plans.{_module}")

FLAGSHIP = "bm25_topk"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
