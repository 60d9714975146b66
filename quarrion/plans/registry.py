"""Registered queries of the core: name, DataFrame builder, DuckDB SQL."""

from __future__ import annotations

import importlib

_MODULES = ["text_queries", "retrieval_queries", "metric_queries", "dataset_queries", "graph_queries", "report_queries", "model_queries"]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"quarrion.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
