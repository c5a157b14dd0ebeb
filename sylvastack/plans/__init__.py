"""Registered queries of the library, by theme."""

from . import layer_queries, sample_queries, scene_queries, workflows  # noqa: F401  (each registers its queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
