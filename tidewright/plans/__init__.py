"""Registered queries: each applies one or more operators to the test tables."""

from tidewright.plans import annotation_queries, chain_queries, check_queries, dialogue_queries, frame_queries, interval_queries, isolation_queries, metric_queries, preparation_queries, relation_queries, source_queries, stream_queries, text_queries  # noqa: F401
from tidewright.plans.registry import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL"]
