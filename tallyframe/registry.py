"""Names for user metrics, aggregations and filters."""

from .functions.filters import FILTERS, register_filter
from .operators.aggregates import (
    AGGREGATIONS,
    METRICS,
    TABLE_AGGREGATIONS,
    register_aggregation,
    register_metric,
)
from .operators.reuse import Responder

__all__ = [
    "AGGREGATIONS",
    "FILTERS",
    "METRICS",
    "TABLE_AGGREGATIONS",
    "Responder",
    "register_aggregation",
    "register_filter",
    "register_metric",
]
