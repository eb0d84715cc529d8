"""Quantiles and ordered helpers against brute force, with one key far larger than the rest."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import quantiles as Q
from gaugeworks.functions.segments import previous_row, range_totals, row_numbers, running_totals
from gaugeworks.operators.calibration import CalibrationRules
from gaugeworks.operators.rules import identifier
from gaugeworks.session import ensure_checkpoint_dir


def interpolated(values, p):
    ordered = sorted(values)
    position = (len(ordered) - 1) * p
    low = int(position)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] * (1 - (position - low)) + ordered[high] * (position - low)


@pytest.mark.parametrize("ties", [False, True])
def test_quantiles_of_a_hot_key_are_exact(spark, ties):
    n = 60_000
    value = F.pmod(F.col("id") * 7919, F.lit(200 if ties else 1_000_003)).cast("double")
    key = F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99)
    frame = spark.range(n).select(key.alias("k"), value.alias("v"))
    groups = {}
    for i in range(n):
        groups.setdefault(i % 5 if i % 3 == 0 else 99, []).append(float((i * 7919) % (200 if ties else 1_000_003)))
    found = Q.exact_quantiles(frame, ["k"], F.col("v"), {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()
    assert len(found) == len(groups)
    for row in found:
        values = groups[row["k"]]
        assert row["n"] == len(values)
        for name, p in (("a", 0.5), ("b", 0.95), ("c", 0.0), ("d", 1.0)):
            assert row[name] == pytest.approx(interpolated(values, p), abs=1e-9)


def test_quantiles_are_exact_whatever_the_sketch_found(spark, monkeypatch):
    monkeypatch.setattr(Q, "ACCURACY", 2)
    monkeypatch.setattr(Q, "MARGIN", 0.0)
    values = [float((7919 * i) % 10007) for i in range(4000)]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "k string, v double").repartition(4)
    found = {r["k"]: r for r in Q.exact_quantiles(frame, ["k"], F.col("v"), {"m": 0.5, "h": 0.9}).collect()}
    assert found["a"]["m"] == interpolated(values, 0.5) and abs(found["a"]["h"] - interpolated(values, 0.9)) < 1e-9
    assert (found["b"]["n"], found["b"]["m"], found["b"]["h"]) == (1, 3.0, 3.0)


def test_quantiles_of_groups_of_every_small_size(spark):
    rng = random.Random(3)
    sizes = [*range(1, 45), 499, 500, 501, 1999, 2001, 4003]
    groups = {n: [rng.choice((rng.uniform(-1e6, 1e6), float(rng.randint(0, 9)))) for _ in range(n)] for n in sizes}
    frame = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k long, v double")
    wanted = {"p0": 0.0, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    found = Q.exact_quantiles(frame.repartition(3), ["k"], F.col("v"), wanted).collect()
    assert sorted(r["k"] for r in found) == sizes
    for row in found:
        for name, p in wanted.items():
            assert row[name] == pytest.approx(interpolated(groups[row["k"]], p), rel=1e-12, abs=1e-9)


def test_quantiles_at_the_ends_of_the_doubles(spark):
    groups = {1: [-1.7e308, -1.0, 0.0, 1.0, 1.7e308], 2: [float("-inf"), 1.0, 2.0], 3: [1.0, 2.0, float("inf")], 4: [-0.0, 0.0, 0.0], 5: [7.0] * 9}
    frame = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    found = {r["k"]: r["m"] for r in Q.exact_median(frame, ["k"], F.col("v"), "m").collect()}
    assert found == {1: 0.0, 2: 1.0, 3: 2.0, 4: 0.0, 5: 7.0}
    assert Q.exact_median(frame.limit(0), ["k"], F.col("v")).isEmpty()


def test_median_and_mad(spark):
    frame = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 10.0, None)], "k int, v double")
    row = Q.median_and_mad(frame, ["k"], F.col("v")).first()
    assert (row["n"], row["median"], row["mad"]) == (3, 2.0, 1.0)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 4}", rng.randint(0, 5000), i, float(rng.randint(0, 9))) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t bigint, i bigint, v double").cache()


def test_previous_row_equals_a_plain_lag(events):
    w = Window.partitionBy("k").orderBy("t", "i")
    wanted = events.select("i", F.lag("v").over(w).alias("p"))
    found = previous_row(events, ["k"], ["t", "i"], ["v"], 100).select("i", F.col("prev_v").alias("p"))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_totals_equal_a_plain_window(events, how):
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.coalesce(F.sum("v").over(w), F.lit(0.0)) if how == "sum" else F.max("v").over(w)
    wanted = events.select("i", plain.alias("b"))
    cuts = [F.floor(F.col("t") / 1000), F.floor(F.col("t") / 50)]
    found = running_totals(events, ["k"], ["t", "i"], cuts, {"x": F.col("v")}, how).select(
        "i", F.col("x_before").alias("b")
    )
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_range_totals_of_crowded_scores_equal_a_plain_window(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else f"k{i % 4}", 1 - i * 1e-12, rng.randint(0, 9)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, p double, v long").repartition(5)
    w = Window.partitionBy("k").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = frame.select("k", "p", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("b"))
    cut = range_totals(frame, ["k"], [F.col("p").desc()], {"x": F.col("v")})
    assert sorted(map(str, cut.select("k", "p", F.col("x_before").alias("b")).collect())) == sorted(map(str, wanted.collect()))


def test_row_numbers_do_not_depend_on_names(spark):
    names = [f"a-long-common-beginning-{i:05d}" for i in range(500)]
    frame = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    found = {r["name"]: r["n"] for r in row_numbers(frame, ["name"], "n").collect()}
    assert found == {n: i for i, n in enumerate(names)}


def test_a_cluster_without_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="shared|share"):
        ensure_checkpoint_dir(Session())


def test_identifiers(spark):
    frame = spark.createDataFrame([("Run.A-.",), ("...",), ("  x y/Z ",), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(identifier(F.col("t"))).collect()] == ["Run.A", None, "x-y-Z", None, None]


def test_calibration_parameters_are_checked():
    for name, bad in (("minimum_sizes", 0), ("minimum_capture_rate", 1.1), ("minimum_dynamic_range", 0.0), ("maximum_interval_relative_error", 1.0), ("threshold_method", "x")):
        with pytest.raises(ValueError, match=name):
            CalibrationRules(**{name: bad})
    CalibrationRules(maximum_interval_relative_error=0.0, minimum_capture_rate=1)
