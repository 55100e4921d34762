"""Queries that bind the operators to the test tables, each with independent SQL."""

from . import code_queries, metric_queries, relational_queries, sequence_queries, source_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code_queries", "metric_queries", "relational_queries", "sequence_queries", "source_queries", "text_queries"]
