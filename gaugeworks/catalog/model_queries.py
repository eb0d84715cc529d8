"""Fitted detectors over per-minute device features of every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.evidence_queries import HOLDOUT
from gaugeworks.catalog.registry import query, round_doubles
from gaugeworks.operators import metrics as M
from gaugeworks.operators import models as D
from gaugeworks.operators import splits as S
from gaugeworks.plans import evaluation as V
from gaugeworks.sources.views import view

COLUMNS = (
    "gpu__utilization_mean",
    "gpu__power_mean",
    "gpu__temperature_max",
    "gpu__pcie_total_mean_bytes_per_s",
    "gpu__pcie_total__communication_duty_cycle",
    "gpu__pcie_total_max",
)


def minute_features(spark: SparkSession, sf_dir: str, lengths: tuple[int, ...] = (60,)) -> DataFrame:
    """Wide rows per (run, tumbling window) with labels; aggregates combine map-side."""
    total = F.col("pcie_tx_bytes_per_s") + F.col("pcie_rx_bytes_per_s")
    telemetry = view(spark, sf_dir, "telemetry").select(
        "run_id",
        "mono_ns",
        "gpu_utilization_pct",
        "power_draw_w",
        "temperature_c",
        total.alias("total"),
        F.explode(F.array(*[F.lit(float(x)) for x in lengths])).alias("window_seconds"),
    )
    index = F.floor(F.col("mono_ns") / (F.col("window_seconds") * 1e9)).alias("window_index")
    features = telemetry.groupBy("run_id", "window_seconds", index).agg(
        F.avg("gpu_utilization_pct").alias("gpu__utilization_mean"),
        F.avg("power_draw_w").alias("gpu__power_mean"),
        F.max("temperature_c").alias("gpu__temperature_max"),
        F.avg("total").alias("gpu__pcie_total_mean_bytes_per_s"),
        F.avg((F.col("total") > 60000).cast("double")).alias("gpu__pcie_total__communication_duty_cycle"),
        F.max("total").alias("gpu__pcie_total_max"),
    )
    runs = view(spark, sf_dir, "runs").select(
        "run_id",
        "experiment_session_id",
        "target_label",
        "workload_family",
        "workload_config_id",
        "designation",
        "legacy_grouping_ambiguous",
    )
    return features.join(runs, "run_id").withColumn("y", (F.col("target_label") == "training").cast("int"))


def benign_split(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    benign = rows.where((F.col("designation") == "benign") & F.col("target_label").isin(*labels))
    assigned = S.stratified_split(S.valid_groups(benign)).select("run_id", "split")
    return benign.join(assigned, "run_id").where("split IS NOT NULL")


@query("detector_candidates", "M-02 M-03 M-04 M-05 M-07 M-09")
def detector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = benign_split(minute_features(spark, sf_dir), ("training", "inference"))
    scores = D.score_candidates(frame, COLUMNS)
    table = M.derived(scores.groupBy("model", "split").agg(*M.confusion(0.5)))
    return round_doubles(table)


@query("detector_multiclass", "M-04 A-58")
def detector_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = benign_split(minute_features(spark, sf_dir), ("training", "inference", "control"))
    predicted = D.multiclass_predictions(frame, COLUMNS)
    return round_doubles(M.multiclass_metrics(predicted, ("training", "inference", "control")))


@query("detector_adversarial_scores", "M-08 A-59")
def detector_adversarial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minute_features(spark, sf_dir)
    benign = benign_split(rows, ("training", "inference"))
    # The strategy name of an adversarial run stands in for its family here.
    names = F.array(*[F.lit(x) for x in (*HOLDOUT.development, *HOLDOUT.hardening, HOLDOUT.final_family)])
    adversarial = rows.where("designation = 'adversarial'").withColumn(
        "workload_family", F.get(names, F.pmod(F.col("run_id"), F.lit(8)).cast("int"))
    )
    scored = D.score_adversarial(benign, adversarial, COLUMNS, HOLDOUT)
    return round_doubles(
        scored.groupBy("workload_family", "round").agg(
            F.count(F.lit(1)).alias("windows"),
            F.count("p").alias("scored_windows"),
            F.avg("p").alias("score_mean"),
        )
    )


@query("detector_family_holdouts", "V-09")
def detector_family_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minute_features(spark, sf_dir).where(
        "designation = 'benign' AND target_label IN ('training', 'inference')"
    )
    return round_doubles(V.evaluate_holdouts(rows, "workload_family", COLUMNS))


@query("detector_by_window_length", "M-10")
def detector_by_window_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = benign_split(minute_features(spark, sf_dir, (60, 180)), ("training", "inference"))
    return round_doubles(V.evaluate_by_window_length(frame, COLUMNS))
