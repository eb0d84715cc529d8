"""Tables read off run evidence: phases, participation, diagnostics, costs, trade-offs, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.quantiles import exact_median
from gaugeworks.functions.segments import previous_row
from gaugeworks.operators.alignment import SEGMENT_NS
from gaugeworks.operators.rules import rank_evidence
from gaugeworks.schemas import TELEMETRY_FIELDS

TX, RX = "pcie_tx_bytes_per_s", "pcie_rx_bytes_per_s"

# --- fixed values: events each rank must have logged, by worker mode ---------
BASE_EVENTS = ("startup", "cuda_operation_complete", "heartbeat", "completion")
MODE_EVENTS = {
    "smoke": (),
    "ddp_train": (
        "measurement_interval",
        "model_ready",
        "forward_complete",
        "backward_complete",
        "gradient_sync_complete",
        "optimizer_step_complete",
        "memory_peak",
    ),
    "calibration": ("measurement_interval", "collective_complete"),
    "idle": ("measurement_interval", "measurement_start", "measurement_end", "process_group_destroyed"),
    "sparse_sync_training": (
        "measurement_interval",
        "model_ready",
        "forward_complete",
        "backward_complete",
        "parameter_average_complete",
        "memory_peak",
    ),
    "synthetic_communication_decoy": ("measurement_interval", "decoy_burst_complete", "memory_peak"),
}
EFFICIENCY_BASELINES = ("ddp_training", "ddp_full_parameter")
# -----------------------------------------------------------------------------


def phase_intervals(events: DataFrame) -> DataFrame:
    """Measured phase per run: the collective span over ranks, else the idle interval common to ranks."""
    c = F.col
    valid = (c("event") == "measurement_interval") & (c("interval_start_ns") <= c("interval_end_ns"))
    spans = events.groupBy("run_id").agg(
        F.min(F.when(c("event") == "collective_start", c("mono_ns"))).alias("first"),
        F.max(F.when(c("event") == "collective_complete", c("mono_ns"))).alias("last"),
        F.max(F.when(valid, c("interval_start_ns"))).alias("idle_start"),
        F.min(F.when(valid, c("interval_end_ns"))).alias("idle_end"),
    )
    idle = c("first").isNull() & c("last").isNull() & (c("idle_start") <= c("idle_end"))
    return spans.select(
        "run_id",
        F.when(idle, c("idle_start")).otherwise(c("first")).alias("phase_start_ns"),
        F.when(idle, c("idle_end")).otherwise(c("last")).alias("phase_end_ns"),
    )


def phase_observations(telemetry: DataFrame, phases: DataFrame) -> DataFrame:
    """Mean and median total traffic inside the phase (ends included); unbounded phases take all."""
    bounded = F.col("phase_start_ns").isNotNull() & F.col("phase_end_ns").isNotNull()
    inside = F.col("mono_ns").between(F.col("phase_start_ns"), F.col("phase_end_ns"))
    rows = telemetry.select("run_id", "mono_ns", (F.col(TX) + F.col(RX)).alias("total")).join(
        phases, "run_id", "left"
    )
    counted = rows.where(~bounded | inside)
    sums = counted.groupBy("run_id").agg(
        F.count("total").alias("sample_count"),
        F.avg("total").alias("mean_bytes_per_s"),
        F.count_if(F.col("total").isNull()).alias("unsupported"),
        F.bool_or(bounded).alias("phase_bounded"),
    )
    middle = exact_median(counted, ["run_id"], F.col("total"), "median_bytes_per_s").drop("n")
    return sums.join(middle, "run_id", "left").select(
        "run_id",
        "sample_count",
        "mean_bytes_per_s",
        "median_bytes_per_s",
        ((F.col("unsupported") == 0) & (F.col("sample_count") > 0)).alias("supported"),
        "phase_bounded",
    )


def measurement_intervals(events: DataFrame) -> DataFrame:
    """Interval shared by both ranks: latest start, earliest end; null unless both ranks report."""
    both = F.count_distinct("rank") == 2
    return events.where("event = 'measurement_interval'").groupBy("run_id").agg(
        F.when(both, F.max("interval_start_ns")).alias("start_ns"),
        F.when(both, F.min("interval_end_ns")).alias("end_ns"),
    )


def participation(events: DataFrame, mode: str, adversarial: bool = False) -> DataFrame:
    """Audit per (run, rank): missing required events, device identity and exit code."""
    required = sorted({*BASE_EVENTS, *MODE_EVENTS[mode], *(("strategy_summary",) if adversarial else ())})
    wanted = F.array(*[F.lit(e) for e in required])
    # Only required names enter the set, so it is bounded by the required list.
    seen = F.collect_set(F.when(F.col("event").isin(*required), F.col("event")))
    return events.groupBy("run_id", "rank").agg(
        F.array_join(F.array_sort(F.array_except(wanted, seen)), ",").alias("missing_events"),
        F.min(F.when(F.col("event") == "startup", F.col("gpu_uuid"))).alias("gpu_uuid"),
        F.when(
            (F.count_if(F.col("event") == "failure") > 0) | (F.count_if(F.col("event") == "completion") == 0), 1
        )
        .otherwise(0)
        .alias("exit_code"),
    )


def participation_summary(per_rank: DataFrame) -> DataFrame:
    """Run verdict: exactly ranks 0 and 1, nothing missing, two distinct devices."""
    c = F.col
    return per_rank.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("ranks"),
        F.count_if((c("missing_events") != "") | c("gpu_uuid").isNull()).alias("incomplete_ranks"),
        F.count_distinct("gpu_uuid").alias("devices"),
        F.max("exit_code").alias("exit_code"),
    ).withColumn(
        "participation_valid",
        (c("ranks") == 2) & (c("incomplete_ranks") == 0) & (c("devices") == 2),
    )


STARTUP_FACTS = ("startup_rank", "local_rank", "gpu_index", "gpu_uuid", "world_size", "backend")
INTERVAL_FACTS = ("interval_start_ns", "interval_end_ns", "measured_duration_seconds")
RANKS = (0, 1)


def required_events(mode: Column, designation: Column) -> Column:
    """Events that each rank must log; a mode without a list of its own asks for the interval alone."""
    lists = [x for m, own in MODE_EVENTS.items() for x in (F.lit(m), F.array(*[F.lit(e) for e in own]).cast("array<string>"))]
    own = F.coalesce(F.try_element_at(F.create_map(*lists), mode), F.array(F.lit("measurement_interval")))
    summary = F.when(designation == "adversarial", F.array(F.lit("strategy_summary"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.concat(F.array(*[F.lit(e) for e in BASE_EVENTS]), own), summary))


def rank_facts(events: DataFrame) -> DataFrame:
    """One row per (run, rank): known event names seen, and the details of the first startup and of
    the first measurement interval in log order. All are partial aggregates of bounded size."""
    names = sorted({*BASE_EVENTS, *(e for own in MODE_EVENTS.values() for e in own), "strategy_summary", "failure"})
    startup, interval = F.col("event") == "startup", F.col("event") == "measurement_interval"
    order = ("mono_ns", *STARTUP_FACTS, *INTERVAL_FACTS)
    return events.where(F.col("rank").isin(*RANKS)).groupBy("run_id", "rank").agg(
        F.collect_set(F.when(F.col("event").isin(*names), F.col("event"))).alias("seen"),
        F.min(F.when(startup, F.struct(*order))).alias("startup"),
        F.min(F.when(interval, F.struct(*order))).alias("interval"),
    )


def participation_audit(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Every problem of the two ranks of each run, in a fixed order, with exit codes and the verdict.

    ``runs`` (run_id, mode, designation); ``events`` (run_id, rank of the log, event, mono_ns and the
    details of startups and intervals, null elsewhere). A rank without a log lacks all its events.
    Details that could not be read as numbers are null, and fail their check. The identities of the
    ranks are compared only where both have a startup.
    """
    facts = rank_facts(events).groupBy("run_id").agg(
        *[F.max(F.when(F.col("rank") == r, F.struct("seen", "startup", "interval"))).alias(f"r{r}") for r in RANKS]
    )
    every = runs.select("run_id", "mode", "designation").join(facts, "run_id", "left")
    wanted = required_events(F.col("mode"), F.col("designation"))
    problems, exits = [], {}
    for r in RANKS:
        seen = F.coalesce(F.col(f"r{r}.seen"), F.array().cast("array<string>"))
        missing = F.array_except(wanted, seen)
        problems.append(F.when(F.size(missing) > 0, F.concat(F.lit(f"rank_{r}_missing:"), F.array_join(missing, "+"))))
        problems.append(F.when(F.col(f"r{r}.startup").isNull(), f"rank_{r}_without_identity"))
        start, end = F.col(f"r{r}.interval.interval_start_ns"), F.col(f"r{r}.interval.interval_end_ns")
        length = F.col(f"r{r}.interval.measured_duration_seconds")
        sound = (end >= start) & (length >= 0) & (F.abs(length - (end - start) / F.lit(1e9)) <= 1e-6)
        problems.append(F.when(F.col(f"r{r}.interval").isNotNull() & ~F.coalesce(sound, F.lit(False)), f"rank_{r}_invalid_interval"))
        failed = F.array_contains(seen, "failure") | ~F.array_contains(seen, "completion")
        exits[f"rank_{r}_exit"] = F.when(failed, 1).otherwise(0)

    def of(fact: str) -> tuple[Column, Column]:
        return F.col(f"r0.startup.{fact}"), F.col(f"r1.startup.{fact}")

    def zero_and_one(fact: str) -> Column:
        a, b = of(fact)
        return F.coalesce(((a == 0) & (b == 1)) | ((a == 1) & (b == 0)), F.lit(False))

    def both(fact: str, value: object) -> Column:
        a, b = of(fact)
        return a.eqNullSafe(F.lit(value)) & b.eqNullSafe(F.lit(value))

    uuid_a, uuid_b = of("gpu_uuid")
    known = F.col("r0.startup").isNotNull() & F.col("r1.startup").isNotNull()
    identity = {
        "ranks_not_zero_and_one": ~zero_and_one("startup_rank"),
        "local_ranks_not_zero_and_one": ~zero_and_one("local_rank"),
        "devices_not_zero_and_one": ~zero_and_one("gpu_index"),
        "device_uuids_not_distinct": uuid_a.eqNullSafe(uuid_b),
        "world_size_not_two": ~both("world_size", 2),
        "backend_not_nccl": ~both("backend", "nccl"),
    }
    problems += [F.when(known & rule, name) for name, rule in identity.items()]
    found = F.array_compact(F.array(*problems))
    return every.select(
        "run_id", "mode", "designation", found.alias("problems"),
        *[code.alias(name) for name, code in exits.items()],
        (F.size(found) == 0).alias("participation_valid"),
    )


def collector_diagnostics(telemetry: DataFrame, requested_interval_s: float, width: int = SEGMENT_NS) -> DataFrame:
    """Interval mean, spread, largest jitter, overruns and missing share per field, per run and device."""
    keys = ["run_id", "gpu_index"]
    stepped = previous_row(telemetry, keys, ["mono_ns", "sequence"], ["mono_ns"], width)
    gap = (F.col("mono_ns") - F.col("prev_mono_ns")) / F.lit(1e9)
    return stepped.withColumn("gap", gap).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_cycles"),
        F.avg("gap").alias("mean_interval_s"),
        F.when(F.count("gap") > 1, F.stddev_pop("gap")).alias("interval_std_s"),
        F.max(F.abs(F.col("gap") - requested_interval_s)).alias("max_abs_jitter_s"),
        F.count_if(F.col("gap") > requested_interval_s).alias("overrun_count"),
        *[F.avg(F.col(f).isNull().cast("double")).alias(f"missing_{f}") for f in TELEMETRY_FIELDS],
    )


def interval_comparison(rows: DataFrame, key: str, value: str, baseline: Column) -> DataFrame:
    """Median of ``value`` per setting and its relative change against the baseline rows."""
    per_setting = exact_median(rows.where(~baseline), [key], F.col(value))
    base = exact_median(rows.where(baseline).withColumn("_one", F.lit(1)), ["_one"], F.col(value), "baseline_median")
    # The baseline is a single row.
    return per_setting.join(F.broadcast(base.drop("n", "_one")), F.lit(True), "left").select(
        key,
        F.col("n").alias("repeats"),
        "median",
        "baseline_median",
        (F.col("median") / F.nullif("baseline_median", F.lit(0.0)) - 1).alias("slowdown_fraction"),
    )


def efficiency(manifests: DataFrame) -> DataFrame:
    """Median wall seconds of each adversarial family against the baseline family.

    A family counts as adversarial by its last manifest in path order.
    """
    done = manifests.where("exit_status = 'completed'")
    families = done.groupBy("workload_family").agg(
        F.count(F.lit(1)).alias("completed_run_count"), F.max_by("designation", "path").alias("designation")
    )
    medians = exact_median(done, ["workload_family"], F.col("wall_seconds"), "median_wall_duration_s").drop("n")
    table = families.join(medians, "workload_family")
    first, second = EFFICIENCY_BASELINES
    base = table.agg(
        F.coalesce(
            F.max(F.when(F.col("workload_family") == first, F.col("median_wall_duration_s"))),
            F.max(F.when(F.col("workload_family") == second, F.col("median_wall_duration_s"))),
        ).alias("baseline_median")
    )
    return table.where("designation = 'adversarial'").join(F.broadcast(base), F.lit(True)).select(
        "workload_family",
        "completed_run_count",
        "median_wall_duration_s",
        "baseline_median",
        (F.col("median_wall_duration_s") / F.nullif("baseline_median", F.lit(0.0))).alias("duration_ratio_vs_baseline"),
    )


def proxy_medians(manifests: DataFrame) -> DataFrame:
    """Median of every rank-level proxy per adversarial family, in long form."""
    done = manifests.where("exit_status = 'completed' AND designation = 'adversarial'")
    names = {
        "sync_rounds_per_rank": "actual_sync_rounds",
        "communication_bytes_proxy_per_rank": "communication_bytes_proxy",
        "throughput_tokens_per_s_per_rank": "throughput_tokens_per_s",
        "final_loss_proxy_per_rank": "final_loss_proxy",
        "peak_allocated_bytes_per_rank": "allocated_bytes",
    }
    long = rank_evidence(done).select(
        "workload_family",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("proxy"), F.col(v).cast("double").alias("v"))
                    for k, v in names.items()
                ]
            )
        ),
    )
    return exact_median(long, ["workload_family", "proxy"], F.col("v"))


def relative_reduction(value: Column, baseline: Column) -> Column:
    return 1 - value / F.nullif(baseline, F.lit(0.0))


def tradeoff(runs: DataFrame, scores: DataFrame, features: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row per run with its score and mean device feature, each value against the k = 1 baseline.

    The baseline is the first k = 1 run by id; it is a single row.
    """
    joined = runs.join(scores, "workload_config_id", "left").join(features, "run_id", "left")
    base = joined.where("local_steps = 1").agg(
        F.min_by(F.struct(*values), "run_id").alias("base")
    )
    return joined.join(F.broadcast(base), F.lit(True), "left").select(
        "run_id",
        "workload_config_id",
        "local_steps",
        "detector_score",
        *values,
        *[
            relative_reduction(F.col(v), F.col("base")[v]).alias(f"{v}_reduction")
            for v in values
        ],
    )


def verify_references(references: DataFrame, calibrations: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each reference against the calibration at its exact path and digest, with mismatching fields."""
    payload = calibrations.select(
        F.col("path").alias("calibration_path"),
        F.col("sha256").alias("actual_sha256"),
        *[F.col(f).alias(f"actual_{f}") for f in fields],
    )
    joined = references.join(payload, "calibration_path", "left")
    found = F.col("actual_sha256").isNotNull()
    problems = F.array_compact(
        F.array(
            F.when(~found, "missing_artifact"),
            F.when(found & (F.col("actual_sha256") != F.col("sha256")), "sha256_mismatch"),
            *[
                F.when(found & ~F.col(f).eqNullSafe(F.col(f"actual_{f}")), f"{f}_mismatch")
                for f in fields
            ],
            F.when(found & (F.col("actual_status") != "supported"), "not_supported"),
            F.when(
                F.col("created_in_session") != (F.col("relationship") == "current_session"),
                "relationship_conflict",
            ),
        )
    )
    return joined.select("reference_id", F.array_join(problems, ",").alias("problems"))


def study_checks(observations: DataFrame, requested_s: float, least_samples: int) -> DataFrame:
    """Failed, short (under 95 percent) and sparse observations per sweep."""
    c = F.col
    return observations.groupBy("sweep_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(~c("exit_status").eqNullSafe("completed")).alias("failed"),
        F.count_if(F.coalesce(c("measured_duration_seconds"), F.lit(0.0)) < 0.95 * requested_s).alias("short"),
        F.count_if(
            F.coalesce(c("measured_duration_seconds") / F.nullif("mean_interval_s", F.lit(0.0)), F.lit(0.0))
            < least_samples
        ).alias("sparse"),
    )


def run_report(manifests: DataFrame) -> DataFrame:
    """Runs and mean duration by family and status."""
    return manifests.groupBy("workload_family", "exit_status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("participation_valid").alias("valid_runs"),
        F.avg("wall_seconds").alias("mean_wall_seconds"),
    )
