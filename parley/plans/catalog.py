"""All registered queries."""

from parley.plans import io_queries, live_queries, manifest_queries, metric_queries, signal_queries, text_queries  # noqa: F401
from parley.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
