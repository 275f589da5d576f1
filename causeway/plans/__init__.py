"""All queries of the library, by area."""

from __future__ import annotations

from causeway.plans import case_queries, evaluation_queries, exploration_queries, feature_queries, model_queries, relational_queries, streaming_queries
from causeway.plans.registry import ORACLES, QUERIES

AREAS = (feature_queries, evaluation_queries, exploration_queries, relational_queries, streaming_queries, model_queries, case_queries)


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
