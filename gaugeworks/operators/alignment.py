"""Pair counts over whole runs, however long the run.

Two-device pairing never reaches across a quiet gap longer than the tolerance, so a
run's merged timeline falls apart into islands that can be paired independently. Each
island is read in time order as a stream with a short queue of unmatched readings; a
run is never gathered in one place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.segments import previous_row, running_totals

SEGMENT_NS = 600 * 1_000_000_000


def islands(samples: DataFrame, tolerance_seconds: float, width: int = SEGMENT_NS) -> DataFrame:
    """Distinct instants per run with reading counts per device and an island number."""
    tolerance = int(tolerance_seconds * 1e9)
    instants = samples.groupBy("run_id", "mono_ns").agg(
        *[F.count(F.when(F.col("gpu_index") == g, 1)).alias(f"n{g}") for g in (0, 1)]
    )
    gaps = previous_row(instants, ["run_id"], ["mono_ns"], ["mono_ns"], width)
    apart = F.coalesce(F.col("mono_ns") - F.col("prev_mono_ns") > tolerance, F.lit(True))
    cut = F.call_function(
        "div", F.col("mono_ns") - F.pmod(F.col("mono_ns"), F.lit(width)), F.lit(width)
    )
    numbered = running_totals(
        gaps.withColumn("starts", apart.cast("long")),
        ["run_id"],
        ["mono_ns"],
        [cut],
        {"starts": F.col("starts")},
    )
    return numbered.select(
        "run_id", (F.col("starts_before") + F.col("starts")).alias("island"), "mono_ns", "n0", "n1"
    )


def pair_counts(samples: DataFrame, tolerance_seconds: float) -> DataFrame:
    """Number of pairs per run under the tolerance, without reuse."""
    if tolerance_seconds < 0:
        raise ValueError(f"samples pair within zero seconds or more, got {tolerance_seconds}")
    tolerance = int(tolerance_seconds * 1e9)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, side, pairs = None, deque(), 0, 0
        for batch in batches:
            done: list[tuple[int, int]] = []
            for run, island, ns, n0, n1 in batch.itertuples(index=False, name=None):
                if (run, island) != key:
                    if key is not None and pairs:
                        done.append((key[0], pairs))
                    key, pairs = (run, island), 0
                    waiting.clear()
                for arriving, count in ((0, n0), (1, n1)):
                    for _ in range(count):
                        if waiting and side != arriving:
                            while waiting and ns - waiting[0] > tolerance:
                                waiting.popleft()
                            if waiting:
                                waiting.popleft()
                                pairs += 1
                                continue
                        side = arriving
                        waiting.append(ns)
            yield pd.DataFrame(done, columns=["run_id", "pairs"])
        if key is not None and pairs:
            yield pd.DataFrame([(key[0], pairs)], columns=["run_id", "pairs"])

    ordered = (
        islands(samples, tolerance_seconds)
        .repartition("run_id", "island")
        .sortWithinPartitions("run_id", "island", "mono_ns")
    )
    return (
        ordered.mapInPandas(scan, "run_id bigint, pairs bigint")
        .groupBy("run_id")
        .agg(F.sum("pairs").alias("aligned_sample_pairs"))
    )
