"""Prep views over the shared tables, and the registered queries with their SQL."""

from . import desk_queries, pit_queries, source_queries, study_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "desk_queries", "pit_queries", "source_queries", "study_queries"]
