"""Coverage: one record per planned run, with the first rule that excluded it.

Gates that need only plans and manifests run before any telemetry is read; telemetry is
reduced to the runs that pass them by a left semi join ahead of the window shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.quantiles import exact_quantiles
from gaugeworks.functions.segments import previous_row
from gaugeworks.operators.alignment import SEGMENT_NS, pair_counts
from gaugeworks.schemas import DESIGNATIONS, SCHEMA_VERSIONS

NS = 1_000_000_000


def manifest_reasons(
    plans: DataFrame, runs: DataFrame, selected: Sequence[str], allowed: DataFrame | None = None
) -> DataFrame:
    """Plans with manifest columns and the first failing plan or manifest gate."""
    if not selected or len(set(selected)) != len(selected) or set(selected) - set(DESIGNATIONS):
        raise ValueError("selected designations must be known, unique and non-empty")
    manifests = runs.select(
        F.col("run_id").alias("accepted_run_id"),
        F.lit(True).alias("has_manifest"),
        F.col("corpus_id").alias("m_corpus"),
        F.col("workload_family").alias("m_family"),
        F.col("target_label").alias("m_label"),
        "exit_status",
        "participation_valid",
        "warmup_seconds",
        "measurement_start_ns",
        "measurement_end_ns",
        "legacy_grouping_ambiguous",
    )
    joined = plans.join(manifests, "accepted_run_id", "left")
    if allowed is not None:
        joined = joined.join(
            allowed.select(
                F.col("run_id").alias("accepted_run_id"), "designation", F.lit(True).alias("is_allowed")
            ).distinct(),
            ["accepted_run_id", "designation"],
            "left",
        )
    else:
        joined = joined.withColumn("is_allowed", F.lit(True))
    c = F.col
    ladder = (
        F.when(c("accepted_run_id").isNull(), "incomplete_run")
        .when(
            ~c("designation").isin(*selected),
            F.when(c("designation") == "calibration", "calibration_run_excluded").otherwise(
                "not_in_selected_corpus"
            ),
        )
        .when(c("is_allowed").isNull(), "not_in_selected_corpus")
        .when(c("has_manifest").isNull(), "incomplete_run")
        .when(c("m_corpus") != c("corpus_id"), "not_in_selected_corpus")
        .when(~c("exit_status").eqNullSafe("completed"), "incomplete_run")
        .when(~F.coalesce("participation_valid", F.lit(False)), "participation_invalid")
        .when(
            ~c("m_family").eqNullSafe(c("workload_family"))
            | ~c("m_label").eqNullSafe(c("target_label")),
            "invalid_manifest",
        )
    )
    return joined.withColumn("manifest_reason", ladder)


def telemetry_facts(telemetry: DataFrame) -> DataFrame:
    """Counts, ends and schema violations per run, in one map-side-combined pass."""
    ns, gpu = F.col("mono_ns"), F.col("gpu_index")
    return telemetry.groupBy("run_id").agg(
        *[F.count(F.when(gpu == g, 1)).alias(f"rows_gpu{g}") for g in (0, 1)],
        *[F.min(F.when(gpu == g, ns)).alias(f"first_{g}") for g in (0, 1)],
        *[F.max(F.when(gpu == g, ns)).alias(f"last_{g}") for g in (0, 1)],
        F.count(F.when(~gpu.isin(0, 1), 1)).alias("other_devices"),
        F.count_if(~F.col("schema_version").isin(*SCHEMA_VERSIONS)).alias("bad_versions"),
        F.count_if((ns < 0) | (F.col("sequence") < 0) | (gpu < 0)).alias("bad_rows"),
    )


def usable_interval(frame: DataFrame, exclude_startup: bool = True) -> DataFrame:
    """Common interval and the usable part of it; both ends inclusive here."""
    start = F.greatest("first_0", "first_1")
    end = F.least("last_0", "last_1")
    both = F.col("first_0").isNotNull() & F.col("first_1").isNotNull()
    staged = frame.withColumns(
        {"common_start_ns": F.when(both, start), "common_end_ns": F.when(both, end)}
    )
    if not exclude_startup:
        return staged.withColumns(
            {"usable_start_ns": F.col("common_start_ns"), "usable_end_ns": F.col("common_end_ns")}
        )
    warmup = (F.coalesce("warmup_seconds", F.lit(0.0)) * NS).cast("long")
    return staged.withColumns(
        {
            "usable_start_ns": F.when(
                F.col("measurement_start_ns").isNotNull(),
                F.greatest("common_start_ns", "measurement_start_ns"),
            ).otherwise(F.col("common_start_ns") + warmup),
            "usable_end_ns": F.least("common_end_ns", "measurement_end_ns"),
        }
    )


def sampling_gaps(telemetry: DataFrame, width: int = SEGMENT_NS) -> DataFrame:
    """Step statistics per (run, device): count, least, median, 95th percentile, most, in seconds."""
    keys = ["run_id", "gpu_index"]
    rows = telemetry.select(*keys, "mono_ns", "sequence")
    stepped = previous_row(rows, keys, ["mono_ns", "sequence"], ["mono_ns"], width)
    gap = (F.col("mono_ns") - F.col("prev_mono_ns")) / F.lit(1e9)
    gaps = stepped.select(*keys, gap.alias("gap")).where("gap IS NOT NULL")
    ends = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interval_count"),
        F.min("gap").alias("minimum"),
        F.max("gap").alias("maximum"),
    )
    middle = exact_quantiles(gaps, keys, F.col("gap"), {"median": 0.5, "p95": 0.95}).drop("n")
    return ends.join(middle, keys)


def length_label(seconds: Column) -> Column:
    """Window length as text without a trailing ".0"."""
    return F.regexp_replace(seconds.cast("string"), r"\.0$", "")


def emitted_windows(kept: DataFrame) -> DataFrame:
    """Kept windows per run as a map from window length to count."""
    counts = kept.groupBy("run_id", "window_seconds").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("run_id").agg(
        F.sum("n").alias("feature_rows"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct(length_label(F.col("window_seconds")).alias("k"), "n"))
            )
        ).alias("emitted"),
    )


def coverage_records(
    plans: DataFrame,
    runs: DataFrame,
    telemetry: DataFrame,
    kept_windows,
    lengths: Sequence[float],
    tolerance_seconds: float,
    selected: Sequence[str] = ("benign",),
    exclude_startup: bool = True,
) -> DataFrame:
    """One record per plan. ``kept_windows(telemetry, runs)`` yields the surviving windows."""
    gated = manifest_reasons(plans, runs, selected)
    passing = gated.where("manifest_reason IS NULL").select(F.col("accepted_run_id").alias("run_id"))
    wanted = telemetry.join(passing, "run_id", "left_semi")
    facts = telemetry_facts(wanted).withColumnRenamed("run_id", "accepted_run_id")
    staged = usable_interval(gated.join(facts, "accepted_run_id", "left"), exclude_startup)
    usable = F.greatest(
        F.lit(0.0), (F.col("usable_end_ns") - F.col("usable_start_ns")) / F.lit(1e9)
    )
    staged = staged.withColumns(
        {
            "overlap_seconds": (F.col("common_end_ns") - F.col("common_start_ns")) / F.lit(1e9),
            "usable_seconds": usable,
        }
    )
    long_enough = staged.where(
        (F.col("manifest_reason").isNull())
        & (F.col("bad_versions") == 0)
        & (F.col("common_end_ns") > F.col("common_start_ns"))
        & (F.col("usable_seconds") >= min(lengths))
    ).select(F.col("accepted_run_id").alias("run_id"), "usable_start_ns", "usable_end_ns")
    in_range = wanted.join(long_enough, "run_id").where(
        F.col("mono_ns").between(F.col("usable_start_ns"), F.col("usable_end_ns"))
    )
    pairs = pair_counts(in_range, tolerance_seconds).withColumnRenamed("run_id", "accepted_run_id")
    windows = emitted_windows(kept_windows(wanted, runs)).withColumnRenamed(
        "run_id", "accepted_run_id"
    )
    joined = staged.join(pairs, "accepted_run_id", "left").join(windows, "accepted_run_id", "left")
    c = F.col
    reason = (
        F.when(c("manifest_reason").isNotNull(), c("manifest_reason"))
        .when(c("rows_gpu0").isNull(), "missing_telemetry")
        .when(c("bad_versions") > 0, "unsupported_telemetry_schema")
        .when(c("bad_rows") > 0, "feature_error")
        .when(
            (c("rows_gpu0") == 0) | (c("rows_gpu1") == 0) | (c("other_devices") > 0),
            "missing_required_gpu",
        )
        .when(c("common_end_ns") <= c("common_start_ns"), "no_common_interval")
        .when(c("usable_seconds") < min(lengths), "post_warmup_interval_too_short")
        .when(F.coalesce("aligned_sample_pairs", F.lit(0)) < 2, "insufficient_samples")
        .when(F.coalesce("feature_rows", F.lit(0)) == 0, "insufficient_samples")
    )
    # A record carries the facts known when its rule fired, as zero or null otherwise.
    read = c("manifest_reason").isNull() & (F.coalesce("bad_versions", F.lit(0)) == 0) & (
        F.coalesce("bad_rows", F.lit(0)) == 0
    )
    two = read & (c("rows_gpu0") > 0) & (c("rows_gpu1") > 0)
    overlapping = two & (c("common_end_ns") > c("common_start_ns"))
    included = c("reason_code").isNull()
    return joined.withColumn("reason_code", reason).select(
        "plan_id",
        c("accepted_run_id").alias("run_id"),
        "workload_family",
        "target_label",
        "designation",
        "corpus_id",
        F.when(included, "included").otherwise("excluded").alias("status"),
        "reason_code",
        *[F.when(read, F.coalesce(f"rows_gpu{g}", F.lit(0))).otherwise(0).alias(f"rows_gpu{g}") for g in (0, 1)],
        F.when(two, c("common_start_ns")).alias("common_start_ns"),
        F.when(two, c("common_end_ns")).alias("common_end_ns"),
        F.when(overlapping, c("overlap_seconds")).otherwise(0.0).alias("common_overlap_seconds"),
        F.when(overlapping, c("usable_seconds")).otherwise(0.0).alias("usable_duration_seconds"),
        F.coalesce("aligned_sample_pairs", F.lit(0)).alias("aligned_sample_pairs"),
        *[
            F.when(
                included, F.coalesce(F.try_element_at("emitted", length_label(F.lit(float(w)))), F.lit(0))
            )
            .otherwise(0)
            .alias(f"emitted_{w:g}")
            for w in lengths
        ],
    )


def extraction_summary(coverage: DataFrame) -> DataFrame:
    """Planned, included and excluded runs, feature rows and the histogram of reasons, per corpus."""
    emitted = [c for c in coverage.columns if c.startswith("emitted_")]
    by_reason = coverage.groupBy("corpus_id", "reason_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(sum(F.col(c) for c in emitted)).alias("windows")
    )
    return by_reason.groupBy("corpus_id").agg(
        F.sum("n").alias("planned_run_count"),
        F.coalesce(F.sum(F.when(F.col("reason_code").isNull(), F.col("n"))), F.lit(0)).alias(
            "included_run_count"
        ),
        F.coalesce(F.sum(F.when(F.col("reason_code").isNotNull(), F.col("n"))), F.lit(0)).alias(
            "excluded_run_count"
        ),
        F.sum("windows").alias("feature_row_count"),
        F.array_join(
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("reason_code").isNotNull(),
                        F.concat_ws("=", "reason_code", F.col("n").cast("string")),
                    )
                )
            ),
            ",",
        ).alias("reason_counts"),
    )


def invariant_violations(coverage: DataFrame, known_reasons: Sequence[str]) -> DataFrame:
    """Names of the coverage invariants each record breaks; empty text for a sound record."""
    c = F.col
    per_plan = coverage.groupBy("plan_id").agg(F.count(F.lit(1)).alias("copies"))
    emitted = [x for x in coverage.columns if x.startswith("emitted_")]
    total = sum(c(x) for x in emitted)
    included = c("status") == "included"
    rules = {
        "duplicate_plan": c("copies") > 1,
        "unknown_status": ~c("status").isin("included", "excluded"),
        "unknown_reason": c("reason_code").isNotNull() & ~c("reason_code").isin(*known_reasons),
        "included_with_reason": included & c("reason_code").isNotNull(),
        "excluded_without_reason": ~included & c("reason_code").isNull(),
        "included_without_run": included & c("run_id").isNull(),
        "included_without_windows": included & (total == 0),
        "excluded_with_windows": ~included & (total > 0),
        "negative_count": (c("rows_gpu0") < 0) | (c("rows_gpu1") < 0) | (c("aligned_sample_pairs") < 0),
        "usable_exceeds_overlap": c("usable_duration_seconds") > c("common_overlap_seconds") + 1e-9,
        "included_without_interval": included & c("common_start_ns").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return (
        coverage.join(per_plan, "plan_id")
        .withColumn("violations", found)
        .select("plan_id", F.array_join("violations", ",").alias("violations"))
    )


def primary_gate(
    coverage: DataFrame,
    families: DataFrame,
    required_lengths: Sequence[float],
    minimum_runs: int = 1,
) -> DataFrame:
    """Per required family: valid runs, failing plans with reasons, and whether it passes.

    ``families`` is the one-column list of required families.
    """
    if minimum_runs < 1 or not required_lengths:
        raise ValueError("a gate needs at least one run and one window length")
    complete = F.lit(True)
    for length in required_lengths:
        complete &= F.col(f"emitted_{length:g}") > 0
    valid = (F.col("status") == "included") & complete & F.col("run_id").isNotNull()
    reason = F.coalesce("reason_code", F.lit("no_common_window_length"))
    marked = coverage.select("workload_family", valid.alias("valid"), reason.alias("reason"))
    counts = marked.groupBy("workload_family", "valid", "reason").agg(F.count(F.lit(1)).alias("n"))
    per_family = counts.groupBy("workload_family").agg(
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("n"))), F.lit(0)).alias("valid_runs"),
        F.array_join(
            F.array_sort(
                F.collect_list(
                    F.when(~F.col("valid"), F.concat_ws("=", "reason", F.col("n").cast("string")))
                )
            ),
            ",",
        ).alias("failures"),
    )
    return (
        families.join(per_family, "workload_family", "left")
        .fillna(0, ["valid_runs"])
        .fillna("", ["failures"])
        .withColumn("passed", F.col("valid_runs") >= minimum_runs)
    )


def family_summary(plans: DataFrame, coverage: DataFrame, primary_length: float) -> DataFrame:
    """Planned, completed, failed, valid and excluded runs per planned family."""
    joined = plans.select("plan_id", "workload_family", "accepted_run_id", "workload_config_id").join(
        coverage.select("plan_id", "status", "reason_code", f"emitted_{primary_length:g}"), "plan_id"
    )
    config = F.coalesce("workload_config_id", F.sha2("plan_id", 256))
    return joined.groupBy("workload_family").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count("accepted_run_id").alias("completed"),
        F.count_if(F.col("accepted_run_id").isNull()).alias("failed"),
        F.count_if(
            (F.col("status") == "included") & (F.col(f"emitted_{primary_length:g}") > 0)
        ).alias("feature_valid"),
        F.count_if(F.col("status") == "excluded").alias("feature_excluded"),
        F.count_distinct(config).alias("config_count"),
        F.count_distinct("reason_code").alias("reason_kinds"),
    )
