"""All registered queries."""

from gaugeworks.catalog import (  # noqa: F401
    calibration_queries,
    contract_queries,
    coverage_queries,
    detector_queries,
    evidence_queries,
    ingest_queries,
    metric_queries,
    model_queries,
    split_queries,
    window_queries,
)
from gaugeworks.catalog.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
