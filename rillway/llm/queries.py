"""All queries of this subpackage: importing this module fills the registry."""

from rillway.llm import conversation_queries, dedup_queries, filter_queries, model_queries, packing_queries, page_queries, text_queries
from rillway.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "conversation_queries", "dedup_queries", "filter_queries", "model_queries", "packing_queries", "page_queries", "text_queries"]
