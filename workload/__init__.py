"""Registered queries: one per operator, with the equivalent SQL where there is one."""
from workload import (  # noqa: F401
    charts,
    cleaning,
    features,
    ingest,
    insights,
    model_checks,
    models,
    profiling,
    relations,
    series,
    statistics,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
