"""Windows of whole batches against the statistics of one window at a time."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import window_batches as B
from gaugeworks.operators import windows as W

LENGTHS = (4.0, 10.0)
FIELDS = ("gpu_utilization_pct", W.TX, W.RX)


@pytest.fixture(scope="module")
def tables(spark):
    """Dense and sparse runs, gaps in the readings, a third device, equal clocks, constant series."""
    rng = random.Random(9)
    rows = []
    for run, (count, span) in enumerate(((400, 60), (60, 100), (8, 60), (300, 15))):
        for i in range(count):
            ns = rng.choice((rng.randrange(span * 10**9), rng.randrange(span) * 10**9))
            tx = None if rng.random() < 0.2 else float(rng.randrange(100_000))
            rows.append((run, rng.choice((0, 0, 1, 1, 2)), ns, i, float(rng.randrange(12)), tx, 7.0 if run == 3 else float(rng.randrange(9))))
    telemetry = spark.createDataFrame(rows, f"run_id long, gpu_index int, mono_ns long, sequence long, {FIELDS[0]} double, {W.TX} double, {W.RX} double")
    return telemetry, W.run_bounds(telemetry, None)


def same(found, wanted):
    names = wanted.columns
    a, b = (sorted(f.select(*names).collect(), key=lambda r: tuple(map(str, r[:7]))) for f in (found, wanted))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for name, u, v in zip(names, x, y, strict=True):
            assert u == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (name, x, y)


@pytest.mark.parametrize("rows", [1, 40_000])
def test_batches_equal_single_windows(tables, monkeypatch, rows):
    monkeypatch.setattr(B, "BATCH_ROWS", rows)
    samples = W.block_samples(*tables, LENGTHS)
    one = W.window_samples(W.assign_windows(*tables, LENGTHS), FIELDS)
    paired = W.window_samples(W.assign_windows(*tables, LENGTHS), FIELDS, 0.3)
    same(B.field_table(samples, LENGTHS, FIELDS), W.field_stats(one, FIELDS))
    pairs = paired.select(*W.WINDOW_KEYS, F.explode("pairs").alias("p")).select(
        *W.WINDOW_KEYS, *[F.col(f"p.{s[0]}.{c}").alias(f"{s}_{n}") for c, n in (("mono_ns", "ns"), ("sequence", "sequence")) for s in ("left", "right")]
    )
    same(B.pair_table(samples, LENGTHS, 0.3), pairs)


def test_wide_rows_equal_single_windows(tables):
    paired = W.window_samples(W.assign_windows(*tables, LENGTHS), FIELDS, 0.3)
    for threshold in (60_000.0, None):
        found = B.feature_table(W.block_samples(*tables, LENGTHS), LENGTHS, FIELDS, 0.3, threshold)
        wanted = W.feature_rows(paired, threshold, FIELDS)
        assert found.columns == wanted.columns
        same(found, wanted)


def test_no_samples_no_windows(tables):
    telemetry, bounds = tables
    assert B.field_table(W.block_samples(telemetry.limit(0), bounds, LENGTHS), LENGTHS, FIELDS).isEmpty()


def test_means_of_wide_rows_and_kept_windows(tables, monkeypatch):
    monkeypatch.setattr(B, "BATCH_ROWS", 50)
    samples = W.block_samples(*tables, LENGTHS)
    wide = B.feature_table(samples, LENGTHS, FIELDS, 0.3, 60_000.0)
    names = [c for c in wide.columns if c.startswith(("gpu", "cross"))]
    found = B.feature_means(samples, LENGTHS, FIELDS, 0.3, 60_000.0, names).select("run_id", "window_seconds", "column_name", "filled_windows", "mean")
    cells = wide.select("run_id", "window_seconds", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in names])))
    wanted = cells.where("v IS NOT NULL").groupBy("run_id", "window_seconds", "column_name").agg(F.count("v").alias("filled_windows"), F.avg("v").alias("mean"))
    same(found, wanted)
    same(B.kept_windows(samples, LENGTHS, 0.3), wide.select(*W.WINDOW_KEYS))
