"""Importing this module registers every query."""

from . import decision_queries, frontier_queries, metric_queries, slate_queries, text_queries  # noqa: F401
from .registry import QUERIES, oracle

__all__ = ["QUERIES", "oracle"]
