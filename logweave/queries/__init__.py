"""Registered queries (Spark builder + DuckDB oracle SQL) over the driver tables."""

from . import q_chains, q_features, q_results, q_sources  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
