"""Registered queries on the driver tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from . import (
    dataset_queries,
    evaluation_queries,
    join_queries,
    order_queries,
    sequence_queries,
    source_queries,
    summary_queries,
)
from .base import REGISTRY, Query

__all__ = [
    "REGISTRY", "Query", "dataset_queries", "evaluation_queries", "join_queries",
    "order_queries", "sequence_queries", "source_queries", "summary_queries",
]
