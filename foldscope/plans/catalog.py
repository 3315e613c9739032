"""All registered queries, by area."""

from foldscope.plans import box_queries, cohort_queries, component_queries, metrics_queries, sampling_queries, scalar_queries  # noqa: F401
from foldscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
