"""Hand-checked windows, statistics and pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import arrays as A
from gaugeworks.operators import windows as W
from gaugeworks.operators.alignment import pair_counts
from gaugeworks.schemas import TELEMETRY_FIELDS

NS = 1_000_000_000


def telemetry(spark, rows):
    """rows: (run_id, gpu, seconds, value); every field has the same value."""
    data = [(r, g, int(t * NS), i, *[v] * len(TELEMETRY_FIELDS)) for i, (r, g, t, v) in enumerate(rows)]
    fields = ", ".join(f"{f} double" for f in TELEMETRY_FIELDS)
    return spark.createDataFrame(data, f"run_id bigint, gpu_index int, mono_ns bigint, sequence bigint, {fields}")


def greedy(left, right, tolerance):
    i = j = 0
    pairs = []
    while i < len(left) and j < len(right):
        delta = left[i] - right[j]
        if abs(delta) <= tolerance:
            pairs.append((left[i], right[j]))
            i, j = i + 1, j + 1
        elif delta < 0:
            i += 1
        else:
            j += 1
    return pairs


def pairs_of(frame):
    return [
        (p["l"]["mono_ns"], p["r"]["mono_ns"]) for row in frame.collect() for p in (row["pairs"] or [])
    ]


def test_pairs_drop_the_unmatched_reading(spark):
    left = F.array(*[F.struct(F.lit(int(t * NS)).alias("mono_ns")) for t in (0, 1, 2)])
    right = F.array(*[F.struct(F.lit(int(t * NS)).alias("mono_ns")) for t in (0.1, 2.1)])
    frame = spark.range(1).select(W.pair_by_time(left, right, 0.15).alias("pairs"))
    assert pairs_of(frame) == [(0, NS // 10), (2 * NS, int(2.1 * NS))]


def test_tolerance_is_inclusive_and_readings_are_not_reused(spark):
    left = F.array(*[F.struct(F.lit(t).cast("long").alias("mono_ns")) for t in (0, NS // 4)])
    right = F.array(F.struct(F.lit(NS // 4).cast("long").alias("mono_ns")))
    frame = spark.range(1).select(W.pair_by_time(left, right, 0.25).alias("pairs"))
    assert pairs_of(frame) == [(0, NS // 4)]


def test_run_pair_counts_equal_the_plain_scan(spark):
    rng = random.Random(7)
    rows, wanted = [], {}
    for run in range(4):
        sides = {}
        for gpu in (0, 1):
            times = sorted(round(rng.uniform(0, 60), 2) for _ in range(rng.randint(5, 120)))
            sides[gpu] = [int(t * NS) for t in times]
            rows += [(run, gpu, t, 1.0) for t in times]
        wanted[run] = len(greedy(sides[0], sides[1], int(0.25 * NS)))
    found = {r["run_id"]: r["aligned_sample_pairs"] for r in pair_counts(telemetry(spark, rows), 0.25).collect()}
    assert found == {run: n for run, n in wanted.items() if n}


def test_windows_are_complete_and_keep_their_index(spark):
    rows = [(1, g, t, float(t)) for g in (0, 1) for t in range(0, 21)]
    frame = telemetry(spark, rows)
    bounds = W.run_bounds(frame, None)
    assigned = W.assign_windows(frame, bounds, (5.0,))
    counts = {
        r["window_index"]: r["count"]
        for r in assigned.where("gpu_index = 0").groupBy("window_index").count().collect()
    }
    # Start 0, exclusive end 20 s + 1 ns, stride 2.5 s: windows 0 to 6 fit.
    assert sorted(counts) == list(range(7))
    assert counts[0] == 5 and counts[1] == 5


def test_windows_do_not_depend_on_partitions_or_row_order(spark):
    rows = [(r, g, t * 0.7, float(t % 9)) for r in (1, 2) for g in (0, 1) for t in range(200)]
    base = telemetry(spark, rows)
    shuffled = telemetry(spark, random.Random(3).sample(rows, len(rows))).drop("sequence")
    shuffled = shuffled.join(base.select("run_id", "gpu_index", "mono_ns", "sequence"), ["run_id", "gpu_index", "mono_ns"])

    def result(frame):
        assigned = W.assign_windows(frame, W.run_bounds(frame, None), (5.0, 15.0))
        stats = W.field_stats(W.window_samples(assigned, ("power_draw_w",)), ("power_draw_w",))
        return sorted(map(tuple, stats.collect()))

    assert result(base) == result(shuffled.repartition(7))


def test_series_statistics_by_hand(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    series = F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(v).alias("y")) for i, v in enumerate(values)])
    s = spark.range(1).select(A.series_stats(series).alias("s")).first()["s"]
    assert s["mean"] == 3.75 and s["min"] == 1.0 and s["max"] == 8.0 and s["p50"] == 3.0
    assert s["p25"] == pytest.approx(1.75) and s["p90"] == pytest.approx(6.8)
    assert s["std"] == pytest.approx(2.680951324)
    assert s["mad"] == pytest.approx(1.5) and s["slope"] == pytest.approx(2.3)


def test_constant_and_single_series_have_no_trend(spark):
    def stats(values):
        series = F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(v).alias("y")) for i, v in enumerate(values)])
        return spark.range(1).select(A.series_stats(series).alias("s")).first()["s"]

    one, same = stats([5.0]), stats([0.1] * 7)
    assert one["std"] == 0.0 and one["slope"] is None and one["autocorr_lag1"] is None
    assert same["std"] == 0.0 and same["autocorr_lag1"] is None


def test_bursts_by_hand(spark):
    values = [0, 9, 9, 0, 9, 0, 0, 9, 9, 9]
    series = F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(float(v)).alias("y")) for i, v in enumerate(values)])
    b = spark.range(1).select(A.bursts(series, F.lit(5.0)).alias("b")).first()["b"]
    assert (b["n"], b["longest"]) == (3, 3)
    assert b["total"] == pytest.approx(2 + 1 + 3) and b["peak"] == pytest.approx(3.0)


def test_arguments_are_checked():
    with pytest.raises(ValueError):
        W.check_window_arguments((5.0, 5.0), 0.5, 0.25)
    with pytest.raises(ValueError):
        W.check_window_arguments((5.0,), 1.5, 0.25)
    with pytest.raises(ValueError):
        W.check_window_arguments((5.0,), 0.5, -1)
