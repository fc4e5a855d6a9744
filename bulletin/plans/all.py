"""All queries: importing the modules registers them."""

from __future__ import annotations

from . import guard_queries, report_queries, rule_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
