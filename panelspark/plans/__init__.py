"""Registered queries (name -> builder) and their SQL cross-checks."""

from panelspark.plans import (  # noqa: F401  (modules register their queries)
    model_queries, more_queries, network_queries, stats_queries, survey_queries)
from panelspark.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
