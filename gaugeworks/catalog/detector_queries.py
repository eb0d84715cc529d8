"""The detector pipeline over the wide feature rows: gates, fit, choice on validation, one test."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog import calibration_queries, coverage_queries
from gaugeworks.catalog.coverage_queries import PRIMARY
from gaugeworks.catalog.registry import query, round_doubles
from gaugeworks.catalog.window_queries import LENGTHS, THRESHOLD, TOLERANCE
from gaugeworks.operators import coverage as C
from gaugeworks.operators import splits as S
from gaugeworks.operators import window_batches as B
from gaugeworks.operators import windows as W
from gaugeworks.operators.features import numeric_candidates
from gaugeworks.plans import evaluation as V
from gaugeworks.schemas import TELEMETRY_FIELDS
from gaugeworks.session import cut_lineage
from gaugeworks.sources.views import view

TASK_FAMILIES = (
    "ddp_training",
    "inference_decode_independent",
    "inference_prefill_independent",
    "inference_synchronized",
)
MINIMUM_RUNS = 3
LABELS = (
    "run_id",
    "experiment_session_id",
    "target_label",
    "workload_family",
    "workload_config_id",
    "designation",
    "legacy_grouping_ambiguous",
)


def labelled_features(spark: SparkSession, sf_dir: str, lengths) -> tuple[DataFrame, list[str]]:
    """Feature rows of the lengths with the labels of their runs, and the eligible columns.

    Runs whose group is ambiguous are left out: one of them would stop the evaluation at its audit.
    """
    telemetry, runs = view(spark, sf_dir, "telemetry"), view(spark, sf_dir, "runs")
    samples = W.block_samples(telemetry, W.run_bounds(telemetry, runs), lengths)
    rows = B.feature_table(samples, lengths, TELEMETRY_FIELDS, TOLERANCE, THRESHOLD)
    columns = numeric_candidates(rows)
    target = (F.col("target_label") == "training").cast("int").alias("y")
    clear = runs.where("NOT coalesce(legacy_grouping_ambiguous, false) AND coalesce(experiment_session_id, '') <> ''")
    return cut_lineage(rows.join(clear.select(*LABELS, target), "run_id")), columns


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calibration = calibration_queries.decision(spark, sf_dir).select(
        F.lit("calibration").alias("gate"),
        F.col("sweep_id").cast("string").alias("subject"),
        F.col("capture_gate_passed").alias("passed"),
        F.col("status").alias("detail"),
    )
    families = spark.createDataFrame([(f,) for f in TASK_FAMILIES], "workload_family string")
    coverage = C.primary_gate(coverage_queries.coverage(spark, sf_dir), families, (PRIMARY,), MINIMUM_RUNS)
    return calibration.unionByName(
        coverage.select(F.lit("coverage").alias("gate"), F.col("workload_family").alias("subject"), "passed", F.col("failures").alias("detail"))
    )


_FAMILIES_SQL = ", ".join(f"('{f}')" for f in TASK_FAMILIES)


@query(
    "detector_pipeline_gates",
    "M-09",
    f"""WITH RECURSIVE out AS (SELECT 1)
        SELECT 'calibration' AS gate, CAST(sweep_id AS VARCHAR) AS subject, capture_gate_passed AS passed, status AS detail
        FROM ({calibration_queries._LADDER}) ladder
        UNION ALL
        SELECT 'coverage', f.workload_family, count(c.plan_id) FILTER (WHERE valid) >= {MINIMUM_RUNS},
               coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) FROM
                 (SELECT coalesce(reason_code, 'no_common_window_length') AS reason, count(*) AS n FROM {{coverage}} x
                  WHERE x.workload_family = f.workload_family AND NOT (status = 'included' AND emitted_360 > 0) GROUP BY 1) q), '')
        FROM (VALUES {_FAMILIES_SQL}) f(workload_family)
        LEFT JOIN (SELECT *, status = 'included' AND emitted_360 > 0 AS valid FROM {{coverage}}) c USING (workload_family)
        GROUP BY f.workload_family""",
    coverage_queries.EXTRA | calibration_queries.EXTRA,
)
def pipeline_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(spark, sf_dir)


#: Status of an evaluation by whether the calibration gate is closed.
STATUS = {False: "evaluated", True: "evaluated_negative_calibration"}


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, dict[str, DataFrame]] | str]:
    """Status, and tables of every feature set or what stopped the evaluation. The three tables below
    read one evaluation, so it is kept for the session and folder."""
    return _evaluated(spark.sparkContext.applicationId, sf_dir)


@lru_cache(maxsize=4)
def _evaluated(application: str, sf_dir: str) -> tuple[str, dict[str, dict[str, DataFrame]] | str]:
    spark = SparkSession.active()
    decision = calibration_queries.decision(spark, sf_dir)
    # Evidence without a calibration is evaluated in the open mode, and every row of the results says so.
    closed = decision.where("NOT capture_gate_passed").limit(1).count() > 0 or decision.limit(1).count() == 0
    features, columns = labelled_features(spark, sf_dir, (PRIMARY,))
    coverage = cut_lineage(coverage_queries.coverage(spark, sf_dir))
    try:
        return STATUS[closed], V.evaluate_detector(
            features, coverage, decision, columns, TASK_FAMILIES, PRIMARY, MINIMUM_RUNS, negative_calibration=closed
        )
    except V.GateError as stopped:
        return "blocked", str(stopped)


def gathered(spark: SparkSession, sf_dir: str, tables: dict[str, str], schema: str) -> DataFrame:
    """The named tables of all feature sets in one; where a gate stopped it, one row with the reason."""
    status, found = evaluated(spark, sf_dir)
    empty = spark.createDataFrame([], schema)
    if isinstance(found, str):
        blocked = spark.createDataFrame([(status, found)], "status string, reason string")
        return round_doubles(empty.unionByName(blocked, allowMissingColumns=True))
    result = empty
    for feature_set, results in found.items():
        for name, level in tables.items():
            table = results[name].withColumns(
                {"feature_set": F.lit(feature_set), "level": F.lit(level), "status": F.lit(status), "reason": F.lit("")}
            )
            wanted = [c for c in empty.columns if c in table.columns]
            result = result.unionByName(table.select(*wanted), allowMissingColumns=True)
    return round_doubles(result)


_COUNTS = "tp long, fp long, fn long, tn long, balanced_accuracy double, training_recall double, false_positive_rate double"


@query("detector_pipeline_selection", "M-07 T-03 T-04")
def pipeline_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = f"feature_set string, level string, status string, reason string, model string, split string, threshold double, validation_score double, auroc double, {_COUNTS}"
    return gathered(spark, sf_dir, {"candidates": "candidate", "selection": "selected"}, schema)


@query("detector_pipeline_test_metrics", "M-07 M-09")
def pipeline_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = (
        "feature_set string, level string, status string, reason string, slice string, slice_value string, "
        f"{_COUNTS}, brier_score double, coverage double, abstention_rate double, selective_risk double, auroc double, "
        "auprc double, median double, ci_low double, ci_high double, hard_negative string"
    )
    tables = {
        "window_level": "window",
        "run_level": "run",
        "brier": "brier",
        "abstention": "abstention",
        "rank_metrics": "rank",
        "bootstrap": "bootstrap",
        "hard_negatives": "hard_negative",
    }
    return gathered(spark, sf_dir, tables, schema)


@query("detector_pipeline_run_predictions", "M-07 A-56")
def pipeline_run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "feature_set string, level string, status string, reason string, run_id long, target int, predicted int, score double, abstained boolean"
    return gathered(spark, sf_dir, {"run_predictions": "run"}, schema)


@query("detector_pipeline_window_lengths", "M-10")
def pipeline_window_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every length on the split of the primary one, on the traffic columns."""
    features, columns = labelled_features(spark, sf_dir, LENGTHS)
    task = features.where("designation = 'benign' AND target_label IN ('training', 'inference')")
    primary = task.where(F.col("window_seconds") == PRIMARY)
    families = tuple(r[0] for r in primary.select("workload_family").distinct().orderBy("workload_family").collect())
    _, assigned = S.choose_strategy(S.valid_groups(primary), families)
    rows = task.join(assigned.select("run_id", "split").where("split IS NOT NULL"), "run_id")
    traffic = V.feature_sets(columns)["communication_only"]
    return round_doubles(V.evaluate_by_window_length(rows, traffic))
