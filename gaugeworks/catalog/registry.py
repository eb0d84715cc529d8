"""Registry of named queries: the Spark job, its check in SQL, and the inventory ids it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.sources import views

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Job
    oracle: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register a job. ``oracle`` may name views as {view}; they become leading CTEs."""

    def register(run: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        text = views.with_views(oracle, extra) if oracle else None
        QUERIES[name] = Query(name, run, text, tuple(covers.split()))
        return run

    return register


# Cut point of the rounding below. Halves are common in means of whole numbers, and the
# engines disagree on them in the last bit; this fraction is not.
SHIFT = 0.3819660112501051


def rounded(column: Column | str) -> Column:
    """Six decimals, two from a magnitude of one thousand: stable across engines."""
    value = F.col(column) if isinstance(column, str) else column

    def cut(scale: float) -> Column:
        return F.floor(value * scale + SHIFT).cast("double") / scale

    return F.when(F.abs(value) < 1000, cut(1e6)).otherwise(cut(100.0))


def rounded_values(values: np.ndarray) -> np.ndarray:
    """The same rounding as :func:`rounded`, of Numpy values."""
    return np.where(np.abs(values) < 1000, np.floor(values * 1e6 + SHIFT) / 1e6, np.floor(values * 100.0 + SHIFT) / 100.0)


def r_sql(expression: str) -> str:
    """The same rounding as :func:`rounded`, in SQL."""
    x = f"CAST({expression} AS DOUBLE)"
    return (
        f"CASE WHEN abs({x}) < 1000 THEN floor({x} * 1000000 + {SHIFT}) / 1000000 "
        f"ELSE floor({x} * 100 + {SHIFT}) / 100 END"
    )


def round_doubles(frame: DataFrame) -> DataFrame:
    """Apply the rounding to every double column (as text: wide frames have hundreds)."""
    doubles = {name for name, kind in frame.dtypes if kind == "double"}
    return frame.selectExpr(
        *[
            f"{r_sql(f'`{c}`')} AS `{c}`" if c in doubles else f"`{c}`"
            for c in frame.columns
        ]
    )
