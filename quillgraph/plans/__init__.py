"""Registered queries over the standard tables, and their SQL."""

from . import discovery_queries, graph_queries, library_queries, note_queries, retrieval_queries, tag_queries, text_queries, upkeep_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
