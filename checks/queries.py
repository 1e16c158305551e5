"""All registered queries."""

from checks import feature_queries, forest_queries, ingest_queries, model_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
