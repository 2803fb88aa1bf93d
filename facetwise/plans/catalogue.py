"""Every query of the library and its SQL, by name."""

from facetwise.plans import entity_queries, mesh_queries, model_queries, report_queries, run_queries, source_queries  # noqa: F401
from facetwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
