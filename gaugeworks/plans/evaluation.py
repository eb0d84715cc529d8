"""Detector evaluation: gates in order, then fit, choose on validation, test once.

Each gate is a small aggregate; the driver only sees its verdict and the chosen model
and threshold. All metrics are queries over one long score table.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import metrics as M
from gaugeworks.operators import models as D
from gaugeworks.operators import splits as S
from gaugeworks.operators.coverage import primary_gate
from gaugeworks.session import cut_lineage


#: Fits that share the cluster.
CONCURRENT_FITS = 4


class GateError(ValueError):
    """An evaluation gate did not pass."""


def feature_sets(columns: Sequence[str]) -> dict[str, list[str]]:
    return {
        "communication_only": [c for c in columns if "pcie_" in c],
        "auxiliary_only": [c for c in columns if "pcie_" not in c],
        "communication_plus_auxiliary": list(columns),
    }


def require_gate(gate: DataFrame) -> None:
    """Raises with the failing families of a gate table (one row per required family)."""
    failing = gate.where("NOT passed").select("workload_family", "valid_runs", "failures").collect()
    if failing:
        raise GateError(f"primary coverage incomplete: {[tuple(r) for r in failing]}")


def evaluate_ablation(
    frame: DataFrame,
    columns: Sequence[str],
    models: Sequence[str] = D.ML_MODELS,
    trees: int = 300,
    diagnostic: bool = False,
) -> dict[str, DataFrame]:
    """Tables of one feature set: candidate metrics, selection, test metrics, runs, abstention.

    Only validation rows take part in the choice of model and threshold. Training and validation
    need both classes, and so does the test part unless the evaluation is only diagnostic.
    """
    reason = missing_for_fit(class_counts(frame), diagnostic)
    if reason is not None:
        raise GateError(reason)
    return judged(frame, cut_lineage(D.score_candidates(frame, columns, models, trees)))


def judged(frame: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """All tables that follow from the scores of one feature set."""
    candidates = M.derived(scores.groupBy("model", "split").agg(*M.confusion(0.5))).join(
        M.rank_metrics(scores, ["model", "split"]), ["model", "split"]
    )
    selection = M.select_model_and_threshold(scores.where("split = 'validation'"))
    chosen = selection.first()
    test = scores.where((F.col("split") == "test") & (F.col("model") == chosen["model"]))
    predictions = M.run_predictions(test, chosen["threshold"])
    return {
        "scores": scores,
        "candidates": candidates,
        "selection": selection,
        "window_level": M.metrics_by_slices(test, chosen["threshold"]),
        "rank_metrics": M.rank_metrics(test, ["split"]),
        "brier": M.brier(test, ["split"]),
        "abstention": M.abstention(test, ["split"], chosen["threshold"]),
        "run_predictions": predictions,
        "run_level": M.derived(
            M.run_scores(test).agg(*M.confusion(chosen["threshold"]))
        ),
        "bootstrap": M.bootstrap_balanced_accuracy(predictions),
        "sample_counts": M.sample_counts(frame),
        "hard_negatives": M.hard_negative_rates(
            M.metrics_by(test, ["workload_family"], chosen["threshold"])
        ),
    }


def evaluate_detector(
    features: DataFrame,
    coverage: DataFrame,
    calibration: DataFrame,
    columns: Sequence[str],
    required_families: Sequence[str],
    primary_length: float,
    minimum_runs: int = 3,
    negative_calibration: bool = False,
    models: Sequence[str] = D.ML_MODELS,
    trees: int = 300,
) -> dict[str, dict[str, DataFrame]]:
    """Calibration gate, coverage gate, whole-run split, leakage audit, then every feature set.

    ``calibration`` has one decision row per sweep. Benign rows of the primary length with
    labels training and inference form the binary task; controls stay out of it, and so does a run
    that its coverage record does not include.
    """
    if not negative_calibration:
        closed = calibration.where("NOT capture_gate_passed").limit(1).count()
        if closed or not calibration.limit(1).count():
            raise GateError("the capture gate of the calibration did not pass")
    spark = features.sparkSession
    families = spark.createDataFrame([(f,) for f in required_families], "workload_family string")
    require_gate(primary_gate(coverage, families, (primary_length,), minimum_runs))
    included = coverage.where("status = 'included'").select("run_id").distinct()
    primary = features.join(included, "run_id", "left_semi").where(
        (F.col("designation") == "benign")
        & (F.col("window_seconds") == primary_length)
        & F.col("target_label").isin("training", "inference")
    ).withColumn("y", (F.col("target_label") == "training").cast("int"))
    groups = S.valid_groups(primary)
    present = {r[0] for r in groups.select("workload_family").distinct().collect()}
    _, assigned = S.choose_strategy(groups, [f for f in required_families if f in present])
    split = assigned.select("run_id", "split").where("split IS NOT NULL")
    audit = S.audit_leakage(primary, columns, split).first()
    if not audit["passed"]:
        raise GateError(f"leakage audit failed: {audit.asDict()}")
    frame = cut_lineage(primary.join(split, "run_id"))
    sets = feature_sets(columns)
    lacking = [name for name, selected in sets.items() if not selected]
    if lacking:
        raise GateError(f"no column for {', '.join(lacking)}")
    with ThreadPool(CONCURRENT_FITS) as pool:
        results = pool.map(lambda selected: evaluate_ablation(frame, selected, models, trees), sets.values())
    return dict(zip(sets, results, strict=True))


def class_counts(frame: DataFrame) -> dict[tuple[str, int], int]:
    """Rows per (split, class): six numbers at most."""
    found = frame.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r["split"], r["y"]): r["n"] for r in found}


def missing_for_fit(counts: dict[tuple[str, int], int], diagnostic: bool = True) -> str | None:
    """Why a split cannot be fitted and judged; ``counts`` are rows per (split, class)."""
    present = {s: sum(counts.get((s, y), 0) > 0 for y in (0, 1)) for s in S.SPLITS}
    empty = [s for s in S.SPLITS if not present[s]]
    if empty:
        return f"no rows in the {' and '.join(empty)} part"
    names = {"train": "training"}
    asked = ("train", "validation") if diagnostic else S.SPLITS
    for split in asked:
        if present[split] < 2:
            return f"the {names.get(split, split)} part does not have both classes"
    return None


def evaluate_holdouts(
    frame: DataFrame,
    field: str,
    columns: Sequence[str],
    models: Sequence[str] = D.ML_MODELS,
    trees: int = 300,
) -> DataFrame:
    """Test metrics of every candidate with each value of ``field`` held out in turn; diagnostic only.

    Each value has a row for every candidate at 0.5, and one for the model and threshold that its
    validation part selects. A value whose split cannot be fitted and judged has one row with status
    insufficient_data and its reason. Each value is a fit, a few at a time side by side; the driver sees the list of values, which the registry
    bounds, and row counts per split and class.
    """
    spark = frame.sparkSession
    frame = cut_lineage(frame.drop("split"))
    groups = cut_lineage(S.valid_groups(frame))
    values = sorted(r[0] for r in groups.select(field).distinct().collect() if r[0] is not None)

    def one(value: object) -> DataFrame:
        rows = cut_lineage(frame.join(S.holdout_split(groups, field, value).select("run_id", "split"), "run_id"))
        reason = missing_for_fit(class_counts(rows))
        if reason is not None:
            return spark.createDataFrame(
                [(str(value), "insufficient_data", reason)], "holdout_value string, status string, reason string"
            )
        scores = cut_lineage(D.score_candidates(rows, columns, models, trees))
        chosen = M.select_model_and_threshold(scores.where("split = 'validation'")).first()
        test = scores.where("split = 'test'")
        at_half = test.groupBy("model").agg(*M.confusion(0.5)).withColumn("threshold", F.lit(0.5))
        selected = test.where(F.col("model") == chosen["model"]).groupBy("model").agg(*M.confusion(chosen["threshold"]))
        both = at_half.withColumn("selected", F.lit(False)).unionByName(
            selected.withColumns({"threshold": F.lit(chosen["threshold"]), "selected": F.lit(True)})
        )
        return M.derived(both).withColumns(
            {"holdout_value": F.lit(str(value)), "status": F.lit("evaluated_diagnostic"), "reason": F.lit("")}
        )

    with ThreadPool(CONCURRENT_FITS) as pool:
        tables = pool.map(one, values)
    # Tables with metrics first, so that the columns come in one order.
    tables.sort(key=lambda t: -len(t.columns))
    result = tables[0] if tables else spark.createDataFrame([], "holdout_value string, status string, reason string")
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def evaluate_by_window_length(
    frame: DataFrame, columns: Sequence[str], models: Sequence[str] = D.ML_MODELS, trees: int = 300
) -> DataFrame:
    """Candidate metrics per window length on one fixed split, and which candidate the validation
    rows of that length select; diagnostic only. The driver sees the list of lengths."""
    lengths = [r[0] for r in frame.select("window_seconds").distinct().orderBy("window_seconds").collect()]

    def one(length: float) -> DataFrame:
        rows = cut_lineage(frame.where(F.col("window_seconds") == length))
        reason = missing_for_fit(class_counts(rows))
        seconds = F.lit(float(length)).alias("window_seconds")
        if reason is not None:
            return frame.sparkSession.range(1).select(seconds, F.lit("insufficient_data").alias("status"), F.lit(reason).alias("reason"))
        scores = cut_lineage(D.score_candidates(rows, columns, models, trees))
        chosen = M.select_model_and_threshold(scores.where("split = 'validation'")).first()
        return M.derived(scores.groupBy("model", "split").agg(*M.confusion(0.5))).select(
            seconds,
            F.lit("evaluated_diagnostic").alias("status"),
            F.lit("").alias("reason"),
            "*",
            (F.col("model") == chosen["model"]).alias("selected"),
            F.lit(chosen["threshold"]).alias("selected_threshold"),
        )

    with ThreadPool(CONCURRENT_FITS) as pool:
        tables = pool.map(one, lengths)
    # No rows, no lengths: an empty table.
    tables.append(frame.sparkSession.createDataFrame([], "window_seconds double, status string, reason string"))
    tables.sort(key=lambda t: -len(t.columns))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
