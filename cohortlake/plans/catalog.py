"""Imports every module of registered queries."""

from cohortlake.plans import queries_exams, queries_load, queries_metrics, queries_models, queries_risk, queries_serving  # noqa: F401
from cohortlake.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
