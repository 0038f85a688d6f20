"""All queries and their SQL; importing the modules registers them."""

from __future__ import annotations

from indemna.plans import claim_queries, evaluation_queries, graph_queries, retrieval_queries, source_queries, terms_queries, text_queries
from indemna.plans.views import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "claim_queries", "evaluation_queries", "graph_queries", "retrieval_queries", "source_queries", "terms_queries", "text_queries"]
