"""What the gates of the detector pipeline say shows in what follows."""

import pytest
from pyspark.sql import functions as F
from test_detector_pipeline import COLUMNS, FAMILIES, MODELS, coverage_frame, feature_frame

from gaugeworks.catalog import detector_queries as Q
from gaugeworks.plans import evaluation as V


def test_runs_that_coverage_excludes_are_not_evaluated(spark, monkeypatch):
    """Of 48 runs, 8 are excluded; each family still has enough."""
    features = feature_frame(spark)
    out = F.col("run_id") % 48 < 8
    coverage = coverage_frame(spark, features).withColumn("status", F.when(out, "excluded").otherwise("included"))
    passed = spark.createDataFrame([(1, True)], "sweep_id int, capture_gate_passed boolean")
    seen = []
    monkeypatch.setattr(V, "evaluate_ablation", lambda frame, *_: seen.append({r[0] for r in frame.select("run_id").distinct().collect()}))
    V.evaluate_detector(features, coverage, passed, COLUMNS, FAMILIES, 30.0, models=MODELS)
    assert seen == [set(range(8, 48))] * 3


@pytest.mark.parametrize("gate, status", [(True, "evaluated"), (False, "evaluated_negative_calibration")])
def test_a_closed_calibration_shows_in_every_row(spark, monkeypatch, gate, status):
    decision = spark.createDataFrame([(1, True), (2, gate)], "sweep_id int, capture_gate_passed boolean")
    modes = []
    table = spark.createDataFrame([(5, 1, 0, 0.25, True)], "run_id long, target int, predicted int, score double, abstained boolean")

    def evaluate(*_, negative_calibration):
        modes.append(negative_calibration)
        return {"communication_only": {"run_predictions": table}}

    monkeypatch.setattr(Q.calibration_queries, "decision", lambda *_: decision)
    monkeypatch.setattr(Q.coverage_queries, "coverage", lambda *_: spark.range(1))
    monkeypatch.setattr(Q, "labelled_features", lambda *_: (spark.range(1), []))
    monkeypatch.setattr(V, "evaluate_detector", evaluate)
    found = Q.pipeline_run_predictions(spark, f"nowhere-{status}").collect()
    assert modes == [not gate] and [(r["run_id"], r["status"]) for r in found] == [(5, status)]
