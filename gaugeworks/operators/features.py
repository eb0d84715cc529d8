"""Feature-row level operators: column roles, run-level means, scoping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.schemas import METADATA_COLUMNS

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")
IDLE_THRESHOLD_COLUMN = "communication_idle_threshold_bytes_per_s"


def numeric_candidates(frame: DataFrame, include_threshold: bool = False) -> list[str]:
    """Sorted numeric columns that are neither identity, label nor window metadata."""
    excluded = set(METADATA_COLUMNS) | (set() if include_threshold else {IDLE_THRESHOLD_COLUMN})
    return sorted(
        name
        for name, kind in frame.dtypes
        if name not in excluded and (kind in NUMERIC or kind.startswith("decimal"))
    )


def column_roles(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per candidate column: filled row count, eligibility and feature-set membership.

    A single aggregate over the feature rows; the result has one row per column.
    """
    counts = frame.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("filled")) for c in columns]
    )
    return counts.select(F.inline(rows)).select(
        "column_name",
        "filled",
        (F.col("filled") > 0).alias("eligible"),
        F.col("column_name").contains("pcie_").alias("communication_only"),
        (~F.col("column_name").contains("pcie_")).alias("auxiliary_only"),
        F.lit(True).alias("communication_plus_auxiliary"),
    )


def run_level_means(
    features: DataFrame, columns: Sequence[str], by_window_length: bool = True
) -> DataFrame:
    """Mean of every column per run (and window length), nulls ignored, plus a window count.

    ``by_window_length=False`` mixes the window lengths of a run in one row.
    """
    keys = ["run_id", "window_seconds"] if by_window_length else ["run_id"]
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_count"), *[F.avg(F.col(f"`{c}`")).alias(c) for c in columns]
    )
