"""Selection, bootstrap, splits and models on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import metrics as M
from gaugeworks.operators import models as D
from gaugeworks.operators import splits as S
from gaugeworks.plans import evaluation as V

COLUMNS = ("gpu0__pcie_total_mean_bytes_per_s", "gpu0__power_draw_w__mean")


@pytest.fixture(scope="module")
def frame(spark):
    """Eighteen runs, three windows each; the traffic column separates the classes."""
    rng = random.Random(1)
    rows = []
    for run in range(18):
        y = run % 2
        for window in range(3):
            rows.append(
                (run, f"s{run % 3}", "training" if y else "inference", f"f{y}", f"c{run}", 30.0, "benign", False, y,
                 1e6 * (1 + 3 * y) + rng.random(), None if rng.random() < 0.2 else rng.random(), ("train", "validation", "test")[run // 2 % 3])
            )
    return spark.createDataFrame(
        rows,
        "run_id bigint, experiment_session_id string, target_label string, workload_family string, workload_config_id string,"
        "window_seconds double, designation string, legacy_grouping_ambiguous boolean, y int,"
        f"{COLUMNS[0]} double, {COLUMNS[1]} double, split string",
    )


def test_selection_prefers_the_earlier_model_and_half(spark):
    rows = [("good", 0, y, p) for y, p in ((1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2))]
    rows += [("twin", 1, y, p) for _, _, y, p in rows] + [("bad", 2, 1, 0.1), ("bad", 2, 0, 0.9)]
    frame = spark.createDataFrame(rows, "model string, model_order int, y int, p double")
    row = M.select_model_and_threshold(frame).first()
    assert (row["model"], row["threshold"], row["validation_score"]) == ("good", 0.5, 1.0)


def test_rank_metrics_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)]
    frame = spark.createDataFrame(rows, "y int, p double").withColumn("k", F.lit(1))
    row = M.rank_metrics(frame, ["k"]).first()
    # Pairs: (.9,.9) half, (.9,.1) one, (.4,.9) none, (.4,.1) one.
    assert row["auroc"] == pytest.approx(2.5 / 4)
    assert row["auprc"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_one_class_has_no_rank_metrics(spark):
    frame = spark.createDataFrame([(1, 0.9), (1, 0.1)], "y int, p double").withColumn("k", F.lit(1))
    row = M.rank_metrics(frame, ["k"]).first()
    assert row["auroc"] is None and row["auprc"] is None


def test_bootstrap_needs_enough_runs(spark):
    def boot(n):
        rows = [(i, i % 2, (i // 2) % 2) for i in range(n)]
        return M.bootstrap_balanced_accuracy(spark.createDataFrame(rows, "run_id int, target int, predicted int"), 50, chunk=7).first()

    few, many = boot(6), boot(40)
    assert few["repetitions"] == 0 and few["ci_low"] is None
    assert many["usable_repetitions"] == 50 and 0 <= many["ci_low"] <= many["median"] <= many["ci_high"] <= 1


def test_split_sizes_shrink_validation_first(spark):
    n = F.col("id")
    rows = spark.range(3, 9).select(n, *[c.alias(k) for k, c in zip("tv", S.split_sizes(n, 0.5, 0.4), strict=True)])
    found = {r["id"]: (r["t"], r["v"]) for r in rows.collect()}
    # Banker's rounding: 3 * .5 -> 2, 5 * .5 -> 2, 7 * .5 -> 4.
    assert found[3] == (1, 1) and found[4] == (2, 1) and found[5] == (2, 2) and found[7] == (4, 2)


def test_split_ignores_row_order_and_keeps_runs_whole(frame):
    groups = S.valid_groups(frame)
    one = {r["run_id"]: r["split"] for r in S.stratified_split(groups).collect()}
    two = {r["run_id"]: r["split"] for r in S.stratified_split(S.valid_groups(frame.repartition(5))).collect()}
    assert one == two and len(one) == 18 and set(one.values()) == {"train", "validation", "test"}


def test_session_holdout_is_found(frame):
    name, assigned = S.choose_strategy(S.valid_groups(frame), ("f0", "f1"))
    assert name == "independent_session_holdout"
    assert assigned.select("split").distinct().count() == 3
    name, _ = S.choose_strategy(S.valid_groups(frame.where("experiment_session_id <> 's0'")), ())
    assert name.startswith("deterministic")


def test_models_separate_and_test_rows_do_not_matter(frame):
    tables = V.evaluate_ablation(frame, COLUMNS, ("logistic_regression", "shallow_decision_tree"), trees=5)
    first = tables["selection"].first()
    assert first["validation_score"] == 1.0
    overall = tables["window_level"].where("slice = 'overall'").first()
    assert overall["balanced_accuracy"] == 1.0
    noisy = frame.withColumn(
        COLUMNS[0], F.when(F.col("split") == "test", F.rand(3)).otherwise(F.col(COLUMNS[0]))
    )
    again = V.evaluate_ablation(noisy, COLUMNS, ("logistic_regression", "shallow_decision_tree"), trees=5)
    assert again["selection"].first() == first


def test_preprocessing_uses_training_rows_only(frame):
    train = frame.where("split = 'train'")
    prepared = D.fit_preprocessing(train.withColumn("void", F.lit(None).cast("double")), (*COLUMNS, "void"))
    assert prepared.dropped == ("void",) and set(prepared.columns) == set(COLUMNS)


def test_leakage_is_seen(spark, frame):
    split = frame.select("run_id", "split").distinct()
    clean = S.audit_leakage(frame, COLUMNS, split).first()
    assert clean["passed"]
    twice = split.unionByName(spark.createDataFrame([(0, "elsewhere")], "run_id bigint, split string"))
    leak = S.audit_leakage(frame, (*COLUMNS, "label_hint"), twice).first()
    assert not leak["passed"] and leak["split_leak_runs"] == 1 and leak["forbidden_columns"] == "label_hint"


def test_calibration_gate_blocks(spark, frame):
    closed = spark.createDataFrame([(1, False)], "sweep_id int, capture_gate_passed boolean")
    with pytest.raises(V.GateError):
        V.evaluate_detector(frame, frame, closed, COLUMNS, ("f0",), 30.0)


def test_a_run_without_split_is_seen(frame):
    split = frame.select("run_id", "split").distinct().where("run_id <> 4")
    audit = S.audit_leakage(frame, COLUMNS, split).first()
    assert audit["runs_without_split"] == 1 and not audit["passed"]


def test_every_holdout_value_has_rows(frame):
    table = V.evaluate_holdouts(frame, "workload_family", COLUMNS, ("shallow_decision_tree",))
    found = {r["holdout_value"]: (r["status"], r["reason"]) for r in table.collect()}
    # Each family is one class: nothing of it is left to learn from.
    assert found == {f: ("insufficient_data", "the training part does not have both classes") for f in ("f0", "f1")}
    configs = V.evaluate_holdouts(frame, "workload_config_id", COLUMNS, ("shallow_decision_tree",))
    assert {r["holdout_value"] for r in configs.where("status = 'evaluated_diagnostic'").collect()} == {f"c{i}" for i in range(18)}


def test_a_mean_at_an_end_of_the_band_abstains_in_any_order(spark):
    scores = [0.1, 0.6, 0.45, 0.3, 0.8, 0.45, 0.7, 0.2, 0.15, 0.75]
    for order in (scores, scores[::-1], sorted(scores)):
        rows = [(1, 1, p) for p in order] + [(2, 0, 0.25), (3, 0, 0.46)]
        frame = spark.createDataFrame(rows, "run_id long, y int, p double").coalesce(1)
        found = {r["run_id"]: (r["score"], r["predicted"], r["abstained"]) for r in M.run_predictions(frame, 0.35).collect()}
        assert found == {1: (0.45, 1, True), 2: (0.25, 0, True), 3: (0.46, 1, False)}
