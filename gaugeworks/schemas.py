"""Record schemas and the fixed values of the evidence formats."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
SCHEMA_VERSIONS = ("1.0", "2.0")
LEGACY_VERSION = "1.0"
CURRENT_VERSION = "2.0"
FIELD_UNITS = {
    "gpu_utilization_pct": "percent",
    "memory_utilization_pct": "percent",
    "memory_used_bytes": "bytes",
    "memory_total_bytes": "bytes",
    "power_draw_w": "watts",
    "temperature_c": "celsius",
    "sm_clock_mhz": "MHz",
    "memory_clock_mhz": "MHz",
    "pcie_tx_bytes_per_s": "bytes/second",
    "pcie_rx_bytes_per_s": "bytes/second",
}
TELEMETRY_FIELDS = tuple(FIELD_UNITS)
LEGACY_TELEMETRY_FIELDS = tuple(f for f in TELEMETRY_FIELDS if f != "memory_total_bytes")
ARTIFACT_KINDS = (
    "environment_report",
    "run_manifest",
    "telemetry_sample",
    "workload_event",
    "feature_row",
    "split_assignment",
    "evaluation_result",
    "experiment_summary",
    "calibration_result",
    "corpus_manifest",
    "coverage_record",
    "feature_extraction_result",
)
DESIGNATIONS = ("benign", "adversarial", "calibration")
EXIT_STATUSES = ("completed", "failed", "timeout")
SPLITS = ("train", "validation", "test")
TARGET_LABELS = ("training", "inference", "control")
PCIE_RAW_UNIT = "KB/second (NVML API)"
PCIE_MULTIPLIER = 1024
METADATA_COLUMNS = (
    "artifact_kind",
    "schema_version",
    "run_id",
    "plan_id",
    "experiment_session_id",
    "collection_id",
    "corpus_id",
    "node_id",
    "source_commit",
    "environment_fingerprint",
    "session_fingerprint",
    "legacy_grouping_ambiguous",
    "target_label",
    "workload_family",
    "workload_config_id",
    "designation",
    "window_seconds",
    "window_index",
    "window_start_monotonic_ns",
    "window_end_monotonic_ns",
    "startup_excluded",
    "sample_count_gpu0",
    "sample_count_gpu1",
    "aligned_sample_pairs",
    "alignment_max_delta_seconds",
)
COVERAGE_REASONS = (
    "not_in_selected_corpus",
    "invalid_manifest",
    "incomplete_run",
    "participation_invalid",
    "calibration_run_excluded",
    "missing_telemetry",
    "missing_required_gpu",
    "no_common_interval",
    "post_warmup_interval_too_short",
    "insufficient_samples",
    "unsupported_telemetry_schema",
    "no_common_window_length",
    "feature_error",
)
# --------------------------------------------------------------------------

READING = T.StructType(
    [
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("supported", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

TELEMETRY_SAMPLE = T.StructType(
    [
        T.StructField("artifact_kind", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("gpu_index", T.IntegerType()),
        T.StructField("gpu_uuid", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("wall_time_utc", T.StringType()),
        T.StructField("monotonic_ns", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), READING)),
        T.StructField("target_sampling_interval_s", T.DoubleType()),
        T.StructField("actual_sampling_interval_s", T.DoubleType()),
        T.StructField("sampling_jitter_s", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("process_id", T.LongType()),
        T.StructField("raw_unit_metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

WORKLOAD_EVENT = T.StructType(
    [
        T.StructField("artifact_kind", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("local_rank", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("wall_time_utc", T.StringType()),
        T.StructField("monotonic_ns", T.LongType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)

RUN_MANIFEST = T.StructType(
    [
        T.StructField("artifact_kind", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("workload_name", T.StringType()),
        T.StructField("workload_label", T.StringType()),
        T.StructField("workload_family", T.StringType()),
        T.StructField("designation", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("random_seed", T.LongType()),
        T.StructField("world_size", T.IntegerType()),
        T.StructField("config", T.StringType()),
        T.StructField("environment_fingerprint", T.StringType()),
        T.StructField("source_commit", T.StringType()),
        T.StructField("source_dirty", T.BooleanType()),
        T.StructField("started_at_utc", T.StringType()),
        T.StructField("ended_at_utc", T.StringType()),
        T.StructField("warmup_seconds", T.DoubleType()),
        T.StructField("exit_status", T.StringType()),
        T.StructField("failure_category", T.StringType()),
        T.StructField("failure_reason", T.StringType()),
        T.StructField("rank_exit_codes", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("participation_valid", T.BooleanType()),
        T.StructField("experiment_session_id", T.StringType()),
        T.StructField("collection_id", T.StringType()),
        T.StructField("corpus_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("measurement_start_monotonic_ns", T.LongType()),
        T.StructField("measurement_end_monotonic_ns", T.LongType()),
        T.StructField("measured_duration_seconds", T.DoubleType()),
        T.StructField("legacy_grouping_ambiguous", T.BooleanType()),
    ]
)

SCHEMA_BY_KIND = {
    "telemetry_sample": TELEMETRY_SAMPLE,
    "workload_event": WORKLOAD_EVENT,
    "run_manifest": RUN_MANIFEST,
}
