"""Queries: the operators applied to whole tables, each with its SQL where SQL can say it."""

from quern.plans import (
    auxiliary_queries, blend_queries, boost_queries, composition_queries, encoding_queries, gate_queries, metric_queries, null_queries, profile_queries, recipe_queries, row_queries, screen_queries, source_queries,
    view_queries,
)
from quern.plans.base import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "auxiliary_queries", "blend_queries", "boost_queries", "composition_queries", "encoding_queries", "gate_queries", "metric_queries", "null_queries", "profile_queries", "recipe_queries", "row_queries",
    "screen_queries", "source_queries", "view_queries",
]
