"""Plan tables: run matrices, adversarial rounds, schedules, resume and the calibration matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.splits import SEED, seeded_hash, seeded_position

# --- fixed values: parameter, least, most, whole numbers only ---------------
STRATEGY_BOUNDS = (
    ("gradient_accumulation", "gradient_accumulation", 2.0, 16.0, True),
    ("periodic_local_sgd", "local_steps", 1.0, 100.0, True),
    ("diloco_inspired", "inner_steps", 2.0, 100.0, True),
    ("segmented_runs", "segment_seconds", 5.0, 20.0, True),
    ("segmented_runs", "restart_gap_seconds", 1.0, 5.0, True),
    ("segmented_runs", "segment_count", 2.0, 8.0, True),
    ("idle_padding", "idle_padding_s", 0.05, 2.0, False),
    ("randomized_synchronization", "sync_probability", 0.1, 0.9, False),
    ("mixed_training_inference", "inference_every", 2.0, 8.0, True),
    ("synthetic_communication_decoy", "payload_mib", 1.0, 16.0, True),
    ("synthetic_communication_decoy", "burst_collectives", 1.0, 8.0, True),
)
STRATEGIES = tuple(dict.fromkeys(row[0] for row in STRATEGY_BOUNDS))
STANDARD_PAYLOADS_MIB = (1, 4, 16, 64, 128)
STANDARD_REPETITIONS = 5
LEAST_MEASURED_SECONDS = 35.0
SAFE_BATCH_SIZE = 4
COLLECTIVE_NAME = r"^collective_(all_reduce|broadcast|all_gather|reduce_scatter|send_recv)_([1-9][0-9]*)mib$"
LOCAL_SGD_NAME = r"^adversarial_periodic_local_sgd_k(1|2|4|8|16)$"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class HoldoutPlan:
    """Families per round, and the identities sealed for the final test."""

    development: tuple[str, ...]
    hardening: tuple[str, ...]
    final_family: str
    final_sessions: tuple[str, ...]
    final_configs: tuple[str, ...]

    def __post_init__(self) -> None:
        parts = [*self.development, *self.hardening, self.final_family]
        if sorted(parts) != sorted(STRATEGIES):
            raise ValueError(f"each of {sorted(STRATEGIES)} belongs to one round of a holdout plan")
        if not self.final_sessions or not self.final_configs:
            raise ValueError("a holdout plan seals at least one session and one configuration for the final test")

    def is_final(self, family: Column, session: Column, config: Column) -> Column:
        return F.coalesce(
            (family == self.final_family)
            | session.isin(*self.final_sessions)
            | config.isin(*self.final_configs),
            F.lit(False),
        )

    def round_of(self, family: Column, session: Column, config: Column, release_final: bool = False) -> Column:
        return (
            F.when(
                self.is_final(family, session, config),
                "final_test" if release_final else "sealed_final_holdout",
            )
            .when(family.isin(*self.hardening), "hardening")
            .when(family.isin(*self.development), "development")
        )


def bound_problems(configs: DataFrame) -> DataFrame:
    """Problem of each (strategy, parameter, value) against the fixed bounds, null if none."""
    bounds = configs.sparkSession.createDataFrame(
        list(STRATEGY_BOUNDS), "strategy_id string, parameter string, low double, high double, whole boolean"
    )
    value = F.col("parameter_value")
    problem = (
        F.when(~F.col("strategy_id").isin(*STRATEGIES), "unknown_strategy")
        .when(F.col("low").isNull(), "unknown_parameter")
        .when(value.isNull(), "missing_value")
        .when(~value.between(F.col("low"), F.col("high")), "out_of_bounds")
        .when(F.col("whole") & (value != F.floor(value)), "not_integral")
    )
    # The bounds are the eleven rows above.
    return configs.join(F.broadcast(bounds), ["strategy_id", "parameter"], "left").withColumn(
        "problem", problem
    )


def matrix_plan(workloads: DataFrame, repetitions: int, seed: int = SEED) -> DataFrame:
    """Every workload of a profile, repeated, in seeded order with stable plan ids."""
    if repetitions < 1:
        raise ValueError(f"a matrix runs every workload once or more, got {repetitions}")
    slots = workloads.select(
        "profile", "workload_name", "entry_id", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("slot")
    ).withColumn("_digest", seeded_hash(seed, F.col("profile"), F.col("workload_name"), F.col("entry_id"), F.col("slot")))
    placed = seeded_position(slots, ["profile"], "_digest")
    # At most ``repetitions`` rows share an entry.
    again = Window.partitionBy("profile", "workload_name", "entry_id").orderBy("position")
    return placed.withColumn("occurrence", (F.row_number().over(again) - 1).cast("long")).select(
        "profile",
        "workload_name",
        "entry_id",
        F.col("position").alias("plan_index"),
        "occurrence",
        F.format_string("%s-%04d-%s-%03d", "profile", "position", "workload_name", "occurrence").alias("plan_id"),
    )


def matrix_estimate(workloads: DataFrame, repetitions: int) -> DataFrame:
    """Run count, device minutes and artifact size per profile."""
    seconds = F.sum(F.coalesce("estimated_seconds", F.lit(60.0))) * repetitions
    return workloads.groupBy("profile").agg(
        (F.count(F.lit(1)) * repetitions).alias("run_count"),
        (seconds * 2 / 60).alias("estimated_gpu_minutes"),
        F.greatest(F.lit(5.0), seconds * 0.02).alias("estimated_artifact_mib"),
    )


def adversarial_plan(configs: DataFrame, plan: HoldoutPlan, repetitions: int) -> DataFrame:
    """Round and slots of every configuration; segmented runs get one slot per segment unless sealed."""
    c = F.col
    round_name = plan.round_of(c("strategy_id"), c("experiment_session_id"), c("config_id"))
    slots = F.when(
        (c("strategy_id") == "segmented_runs") & (c("round") != "sealed_final_holdout"), c("segment_count")
    ).otherwise(1)
    return (
        configs.withColumn("round", round_name)
        .where("round IS NOT NULL")
        .select(
            "entry_id",
            "strategy_id",
            "round",
            slots.alias("slot_count"),
            F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"),
        )
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slot_count") - 1)))
        .select(
            "entry_id",
            "round",
            "repetition",
            "slot",
            F.format_string("adversarial-%s-r%03d-s%03d", "strategy_id", "repetition", "slot").alias("plan_id"),
        )
    )


def sealed_counts(plans: DataFrame) -> DataFrame:
    """Planned, sealed, completed and failed per family; sealed plans do not count as failed."""
    sealed = F.col("round") == "sealed_final_holdout"
    done = F.col("accepted_run_id").isNotNull()
    return plans.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(sealed).alias("sealed"),
        F.count_if(done).alias("completed"),
        F.count_if(~done & ~sealed).alias("failed"),
    )


def sync_schedule(configs: DataFrame, seed: int = SEED) -> DataFrame:
    """Synchronization flag of every step: each k-th step, or a seeded draw; the last step always.

    ``every`` or ``probability`` is set per configuration.
    """
    steps = configs.select(
        "entry_id", "steps", "every", "probability", F.explode(F.sequence(F.lit(1).cast("long"), F.col("steps"))).alias("step")
    )
    digest = seeded_hash(seed, F.col("entry_id"), F.col("step"))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))
    periodic = F.pmod(F.col("step"), F.col("every")) == 0
    rule = F.when(F.col("every").isNotNull(), periodic).otherwise(draw < F.col("probability"))
    return steps.select("entry_id", "step", (rule | (F.col("step") == F.col("steps"))).alias("synchronize"))


def registry_problems(workloads: DataFrame) -> DataFrame:
    """Registry entries with missing fields, shared ids, bad durations or unsafe sizes."""
    shared = workloads.where("config_id IS NOT NULL").groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("config_id", F.lit(True).alias("is_shared"))
    c = F.col
    benign = c("designation") == "benign"
    found = F.array_compact(
        F.array(
            F.when(c("config_id").isNull(), "missing_config_id"),
            F.when(c("is_shared"), "shared_config_id"),
            F.when(benign & (c("warmup_seconds") < 0), "negative_warmup"),
            F.when(c("min_measured_seconds") < LEAST_MEASURED_SECONDS, "measured_too_short"),
            F.when(c("estimated_seconds") < c("warmup_seconds") + c("min_measured_seconds"), "estimate_too_short"),
            F.when(benign & (c("batch_size") > SAFE_BATCH_SIZE), "batch_size_above_bound"),
        )
    )
    return workloads.join(shared, "config_id", "left").select("entry_id", F.array_join(found, ",").alias("problems"))


def parse_workload_name(name: Column) -> list[Column]:
    """Kind, collective, payload and step count read from a workload name."""
    collective, payload = (F.regexp_extract(name, COLLECTIVE_NAME, group) for group in (1, 2))
    steps = F.regexp_extract(name, LOCAL_SGD_NAME, 1)
    return [
        F.when(F.length(collective) > 0, "calibration")
        .when(F.length(steps) > 0, "periodic_local_sgd")
        .when(name.startswith("collective_") | name.startswith("adversarial_"), "unknown")
        .otherwise("registered")
        .alias("kind"),
        F.when(F.length(collective) > 0, collective).alias("collective"),
        F.when(F.length(payload) > 0, payload.cast("long")).alias("payload_mib"),
        F.when(F.length(steps) > 0, steps.cast("long")).alias("local_steps"),
    ]


def resume_status(plans: DataFrame, attempts: DataFrame, least_seconds: float = 30.0) -> DataFrame:
    """Status of each plan against its earlier attempts: mismatch, duplicate, accepted or pending."""
    good = (
        (F.col("exit_status") == "completed")
        & F.col("participation_valid")
        & (F.coalesce("measured_duration_seconds", F.lit(0.0)) >= least_seconds)
    )
    joined = plans.join(attempts.withColumnRenamed("planned_hash", "attempt_hash"), "plan_id", "left")
    facts = joined.groupBy("plan_id").agg(
        F.count("run_id").alias("attempts"),
        F.count_if(F.col("attempt_hash") != F.col("planned_hash")).alias("mismatches"),
        F.count_if(good).alias("accepted"),
        F.min(F.when(good, F.col("run_id"))).alias("candidate"),
    )
    status = (
        F.when(F.col("mismatches") > 0, "mismatched_attempt")
        .when(F.col("accepted") > 1, "duplicate_accepted")
        .when(F.col("accepted") == 1, "accepted")
        .otherwise("pending")
    )
    return facts.select(
        "plan_id",
        "attempts",
        status.alias("status"),
        F.when(status == "accepted", F.col("candidate")).alias("accepted_run_id"),
    )


def expected_calibration_matrix(
    sweeps: DataFrame,
    repetitions: int = STANDARD_REPETITIONS,
    payloads: Sequence[int] = STANDARD_PAYLOADS_MIB,
) -> DataFrame:
    """Idle plus every payload, for each repetition of each sweep."""
    cells = F.array(
        F.struct(F.lit("idle_baseline").alias("kind"), F.lit(0.0).alias("payload")),
        *[F.struct(F.lit("collective").alias("kind"), F.lit(float(p)).alias("payload")) for p in payloads],
    )
    return sweeps.select(
        "sweep_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repetitions - 1).cast("long"))).alias("repetition"), cells.alias("cells")
    ).select("sweep_id", "repetition", F.inline("cells"))


def calibration_matrix_diff(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Cells that are missing, repeated or not expected, from a full outer join on the cell key."""
    keys = ["sweep_id", "repetition", "kind", "payload"]
    counts = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = expected.withColumn("wanted", F.lit(True)).join(counts, keys, "full_outer")
    problem = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("n") > 1, "repeated")
    )
    return joined.select(*keys, F.coalesce("n", F.lit(0)).alias("observations"), problem.alias("problem")).where(
        "problem IS NOT NULL"
    )
