"""Loads every query module so that the registry is complete."""

from raregrain.plans import (
    evaluation_queries, model_queries, sampling_queries, source_queries, table_queries, text_queries, workflow_queries,
)
from raregrain.plans.registry import ORACLES, QUERIES
from raregrain.plans.text_queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

_MODULES = (text_queries, table_queries, sampling_queries, evaluation_queries, source_queries, model_queries, workflow_queries)
