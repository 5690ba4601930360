"""All queries of the engine, and the flagship."""

from __future__ import annotations

from tracelode.plans import evaluation_queries, evolution_queries, import_queries, recall_queries, state_queries, trace_queries, truth_queries
from tracelode.plans.registry import ORACLE_SQL, QUERIES

MODULES = (trace_queries, import_queries, recall_queries, evolution_queries, state_queries, evaluation_queries, truth_queries)
FLAGSHIP = QUERIES["rec06_hybrid_recall"]

__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
