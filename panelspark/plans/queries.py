"""All registered queries."""

from __future__ import annotations

from panelspark.plans import queries_evaluation, queries_panel, queries_store, queries_tables  # noqa: F401
from panelspark.plans.registry import QUERIES

__all__ = ["QUERIES"]
