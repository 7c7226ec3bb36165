"""Registered queries, by area."""

from tidemark.plans import documents, extras, intervals, ranking, relational, scoring, sequential, text
from tidemark.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "documents", "extras", "intervals", "ranking", "relational", "scoring", "sequential", "text"]
