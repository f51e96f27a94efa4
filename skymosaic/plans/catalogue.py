"""Query catalogue: importing it registers every query and, where SQL can express it, the SQL of the same rows."""

from __future__ import annotations

from . import cluster_queries, evaluation_queries, geometry_queries, source_queries, split_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
