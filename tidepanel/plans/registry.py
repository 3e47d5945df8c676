"""All queries of the panel operators by name, with their DuckDB counterparts."""

from __future__ import annotations

from tidepanel.plans import audit_queries, catalog_queries, cost_queries, feature_queries, fold_queries, gate_queries, history_queries, ingest_queries, intake_queries, leakage_queries, lifecycle_queries, model_queries, more_queries, ranking_queries, return_queries, run_queries, shard_queries, update_queries  # noqa: F401  they register themselves
from tidepanel.plans.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
