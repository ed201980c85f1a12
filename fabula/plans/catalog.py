"""All registered queries of the library itself."""

from __future__ import annotations

from . import analysis_queries, event_queries, graph_queries, nested_queries, prediction_queries, relational_queries, report_queries, retrieval_queries, service_queries, text_queries, workflow_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
