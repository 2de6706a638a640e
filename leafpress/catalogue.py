"""Registered queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from leafpress.plans import edit_queries, function_queries, package_edit_queries, package_queries, read_queries, resolve_queries, structure_queries  # noqa: F401
from leafpress.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
