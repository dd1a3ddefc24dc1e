"""All registered queries: importing this module fills the registry."""

from rillway.plans import document_queries, row_queries, source_queries, text_queries, workload_queries
from rillway.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "document_queries", "row_queries", "source_queries", "text_queries", "workload_queries"]
