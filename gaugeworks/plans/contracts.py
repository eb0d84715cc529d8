"""Contracts of configurations and corpora: bounded strategies, the workload registry and its
profiles, planned runs and corpus headers.

Every rule is a column over one row; a row lists all rules it breaks, in a fixed order, where a
launcher would stop at the first. Only what spans rows (shared ids, missing families, foreign
profile members) groups or joins, on narrow keys. Null counts as absent. Empty tables give no rows,
but for the families that a registry must hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.plans.matrix import LEAST_MEASURED_SECONDS, STRATEGIES, STRATEGY_BOUNDS
from gaugeworks.schemas import CURRENT_VERSION, DESIGNATIONS

# --- fixed values -----------------------------------------------------------
# Strategy (also its family), label, worker mode.
STRATEGY_CONTRACTS = (
    ("gradient_accumulation", "training", "ddp_train"),
    ("periodic_local_sgd", "training", "sparse_sync_training"),
    ("diloco_inspired", "training", "sparse_sync_training"),
    ("segmented_runs", "training", "ddp_train"),
    ("idle_padding", "training", "ddp_train"),
    ("randomized_synchronization", "training", "sparse_sync_training"),
    ("mixed_training_inference", "training", "ddp_train"),
    ("synthetic_communication_decoy", "control", "synthetic_communication_decoy"),
)
# Parameter, least, most, whole numbers only; judged where given.
COMMON_BOUNDS = (
    ("batch_size", 1.0, 4.0, True),
    ("sequence_length", 32.0, 512.0, True),
    ("hidden_size", 64.0, 256.0, True),
    ("layers", 1.0, 3.0, True),
    ("heads", 1.0, 8.0, True),
    ("warmup_seconds", 0.0, 10.0, False),
)
PRECISIONS = ("float16", "float32", "bfloat16")
MOST_MEASURED_SECONDS = 60.0
REGISTRY_FIELDS = ("config_id", "mode", "label", "family", "designation")
BENIGN_LIMITS = (
    ("batch_size", 4),
    ("sequence_length", 512),
    ("hidden_size", 256),
    ("layers", 3),
    ("matrix_size", 2048),
    ("payload_mib", 64),
)
BENIGN_FAMILIES = (
    "ddp_training",
    "inference_prefill_independent",
    "inference_decode_independent",
    "inference_synchronized",
    "control_compute",
    "control_host_transfer",
    "control_model_or_checkpoint_load",
    "control_idle",
)
CORPUS_FIELDS = ("corpus_id", "collection_id", "experiment_session_id", "node_id", "source_commit")
PLANNED_FIELDS = ("plan_id", "workload_family", "target_label")
REFERENCE_FIELDS = (
    "calibration_artifact_path",
    "calibration_sha256",
    "calibration_experiment_session_id",
    "calibration_collection_id",
    "calibration_environment_fingerprint",
    "calibration_source_commit",
    "calibration_schema_version",
    "calibration_status",
    "calibration_relationship",
    "calibration_created_in_current_session",
)
# ----------------------------------------------------------------------------


def broken(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that are true, in their order; a rule that is null does not fire."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def absent(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def differs(column: Column, wanted) -> Column:
    return ~column.eqNullSafe(wanted)


def bound_rules(name: str, low: float, high: float, whole: bool, where: Column) -> dict[str, Column]:
    value = F.col(name)
    inside = value.between(low, high)
    rules = {f"{name}_out_of_bounds": where & ~inside}
    if whole:
        rules[f"{name}_not_integral"] = where & inside & (value != F.floor(value))
    return rules


def strategy_problems(configs: DataFrame) -> Column:
    """Rules of its strategy that a configuration breaks; an unknown strategy has that problem alone.

    ``configs`` is wide: one column per parameter of :data:`STRATEGY_BOUNDS`, :data:`COMMON_BOUNDS`
    and the identity columns; columns that are lacking count as null.
    """
    known, anything = F.col("strategy_id").isin(*STRATEGIES), F.lit(True)
    have = set(configs.columns)

    def contract(position: int) -> Column:
        pairs = [F.lit(x) for row in STRATEGY_CONTRACTS for x in (row[0], row[position])]
        return F.try_element_at(F.create_map(*pairs), F.col("strategy_id"))

    rules = {
        "family_mismatch": differs(F.col("family"), F.col("strategy_id")),
        "label_mismatch": differs(F.col("label"), contract(1)),
        "mode_mismatch": differs(F.col("mode"), contract(2)),
        "designation_not_adversarial": differs(F.col("designation"), F.lit("adversarial")),
        "enabled_by_default": differs(F.col("enabled_by_default"), F.lit(False)),
        "approval_not_required": differs(F.col("requires_human_approval"), F.lit(True)),
    }
    for strategy, name, low, high, whole in STRATEGY_BOUNDS:
        own = F.col("strategy_id") == strategy
        if name not in have:
            rules[f"{name}_missing"] = own
            continue
        rules[f"{name}_missing"] = own & F.col(name).isNull()
        rules |= bound_rules(name, low, high, whole, own)
    for name, low, high, whole in COMMON_BOUNDS:
        if name in have:
            rules |= bound_rules(name, low, high, whole, anything)
    if {"hidden_size", "heads"} <= have:
        size, heads = (F.col(n).try_cast("long") for n in ("hidden_size", "heads"))
        rules["hidden_size_not_divisible_by_heads"] = size % F.nullif(heads, F.lit(0)) != 0
    if "precision" in have:
        rules["precision_unknown"] = ~F.col("precision").isin(*PRECISIONS)
    measured = F.coalesce("min_measured_seconds", F.lit(0.0))
    segmented = F.col("strategy_id") == "segmented_runs"
    if "segment_seconds" in have:
        rules["duration_is_not_the_segment"] = segmented & (measured != F.col("segment_seconds"))
    rules["duration_out_of_range"] = ~segmented & ~measured.between(LEAST_MEASURED_SECONDS, MOST_MEASURED_SECONDS)
    return F.when(known, broken(rules)).otherwise(F.array(F.lit("unknown_strategy")))


def judge_strategies(configs: DataFrame) -> DataFrame:
    """(entry_id, problems) of every configuration that names a strategy or is adversarial."""
    judged = F.col("strategy_id").isNotNull() | (F.col("designation") == "adversarial")
    return configs.where(judged).select("entry_id", strategy_problems(configs).alias("problems"))


def judge_registry(workloads: DataFrame) -> DataFrame:
    """(entry_id, problems) of every registry entry: its fields, a shared id, its durations, and what
    its designation asks for; an adversarial entry also has the problems of its strategy.

    Ids are counted map-side, and only the shared ones are joined back.
    """
    c, zero = F.col, F.lit(0.0)
    named = workloads.where(~absent("config_id"))
    shared = named.groupBy("config_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = workloads.join(shared.select("config_id", F.lit(True).alias("is_shared")), "config_id", "left")
    benign, adversarial = c("designation") == "benign", c("designation") == "adversarial"
    warmup, measured, estimate = (
        F.coalesce(c(n), zero) for n in ("warmup_seconds", "min_measured_seconds", "estimated_seconds")
    )
    least = F.when(c("strategy_id") == "segmented_runs", c("segment_seconds")).otherwise(LEAST_MEASURED_SECONDS)
    rules = {f"missing_{n}": absent(n) for n in REGISTRY_FIELDS}
    rules["shared_config_id"] = c("is_shared")
    rules["negative_warmup"] = benign & (F.coalesce("warmup_seconds", F.lit(-1.0)) < 0)
    rules["measured_too_short"] = (benign & (measured < LEAST_MEASURED_SECONDS)) | (adversarial & (measured < least))
    rules["estimate_too_short"] = (benign | adversarial) & (estimate < warmup + measured)
    # Sizes are compared as whole numbers, cut toward zero.
    rules |= {f"{n}_above_limit": benign & (c(n).try_cast("long") > most) for n, most in BENIGN_LIMITS}
    strategy = F.when(adversarial, strategy_problems(workloads)).otherwise(F.array().cast("array<string>"))
    return rows.select("entry_id", F.concat(broken(rules), strategy).alias("problems"))


def registry_gaps(workloads: DataFrame, profiles: DataFrame) -> DataFrame:
    """(scope, item, problem): benign families without an entry, profile members that are not in the
    registry, and adversarial profiles that lack a strategy or hold another family.

    ``profiles`` has profile, workload_name and adversarial. An unknown member has no family.
    """
    spark = workloads.sparkSession
    families = workloads.where("designation = 'benign'").select(F.col("family").alias("item")).distinct()
    wanted = spark.createDataFrame([(f,) for f in BENIGN_FAMILIES], "item string")
    missing = wanted.join(families, "item", "left_anti").select(
        F.lit("registry").alias("scope"), "item", F.lit("missing_family").alias("problem")
    )
    known = workloads.select("workload_name", "family").where("workload_name IS NOT NULL").dropDuplicates(["workload_name"])
    members = profiles.join(known.withColumn("known", F.lit(True)), "workload_name", "left")
    unknown = members.where("known IS NULL").select(
        F.col("profile").alias("scope"), F.col("workload_name").alias("item"), F.lit("unknown_workload").alias("problem")
    )
    held = members.where("adversarial AND known").select("profile", "family").distinct()
    foreign = held.where(~F.coalesce(F.col("family").isin(*STRATEGIES), F.lit(False)))
    # One row for each profile and each of the eight strategies.
    asked = profiles.where("adversarial").select("profile").distinct().withColumn("family", F.explode(F.array(*map(F.lit, STRATEGIES))))
    lacking = asked.join(held, ["profile", "family"], "left_anti")
    pairs = [(unknown, None), (foreign, "foreign_family"), (lacking, "missing_strategy")]
    for frame, problem in pairs:
        if problem:
            frame = frame.select(F.col("profile").alias("scope"), F.col("family").alias("item"), F.lit(problem).alias("problem"))
        missing = missing.unionByName(frame)
    return missing.distinct()


def judge_corpora(corpora: DataFrame, plans: DataFrame, accepted: DataFrame) -> DataFrame:
    """(corpus_id, problems) of every corpus: its header, its reference to a calibration, whether it
    plans runs, and whether plan and list of accepted runs agree.

    ``corpora`` holds the header with ``random_seed``, ``source_dirty`` and ``input_archive_sha256``, and
    ``calibration_reference`` as JSON text (null: none). ``plans`` has corpus_id, plan_id,
    accepted_run_id and the fields of :func:`planned_run_rules`; ``accepted`` has corpus_id and run_id.
    Ids are counted per corpus and id, so a corpus of any size stays spread; what reaches a corpus row
    is whether a kind of problem occurs.
    """
    c = F.col
    per_plan = plans.groupBy("corpus_id", "plan_id").agg(
        F.count(F.lit(1)).alias("copies"), F.bool_or(F.size(planned_run_problems()) > 0).alias("unsound")
    )
    of_plans = per_plan.groupBy("corpus_id").agg(
        F.bool_or(c("plan_id").isNotNull() & (c("copies") > 1)).alias("repeated_plan"),
        F.bool_or("unsound").alias("unsound_plan"),
        F.lit(True).alias("planned"),
    )
    assigned = plans.where("accepted_run_id IS NOT NULL").groupBy("corpus_id", c("accepted_run_id").alias("run_id"))
    listed = accepted.groupBy("corpus_id", "run_id").agg(F.count(F.lit(1)).alias("listings"))
    sides = assigned.agg(F.count(F.lit(1)).alias("plans")).join(listed, ["corpus_id", "run_id"], "full_outer")
    of_runs = sides.groupBy("corpus_id").agg(
        F.bool_or(c("plans") > 1).alias("assigned_twice"),
        F.bool_or(c("listings") > 1).alias("listed_twice"),
        F.bool_or(c("listings").isNull()).alias("not_listed"),
        F.bool_or(c("plans").isNull()).alias("not_assigned"),
    )
    digest = "^[0-9a-f]{64}$"
    reference = F.from_json("calibration_reference", "map<string,string>")
    rows = corpora.withColumn("reference", reference)
    rows = rows.join(of_plans, "corpus_id", "left").join(of_runs, "corpus_id", "left")
    given, held = c("calibration_reference").isNotNull(), F.coalesce(F.map_keys("reference"), F.array().cast("array<string>"))
    path, relation = c("reference")["calibration_artifact_path"], c("reference")["calibration_relationship"]
    complete = F.size(F.array_except(F.array(*map(F.lit, REFERENCE_FIELDS)), held)) == 0
    inside = (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), F.lit(".."))
    rules = {"unsupported_version": differs(c("schema_version"), F.lit(CURRENT_VERSION))}
    rules |= {f"missing_{n}": absent(n) for n in CORPUS_FIELDS}
    rules |= {
        "wrong_kind": differs(c("artifact_kind"), F.lit("corpus_manifest")),
        "source_dirty_unknown": c("source_dirty").isNull(),
        "negative_seed": F.coalesce(c("random_seed") < 0, F.lit(True)),
        "archive_digest_malformed": ~c("input_archive_sha256").rlike(digest),
        "reference_incomplete": given & ~complete,
        "reference_path_invalid": given & complete & ~F.coalesce(inside, F.lit(False)),
        "reference_digest_malformed": given & complete & ~F.coalesce(c("reference")["calibration_sha256"].rlike(digest), F.lit(False)),
        "reference_relationship_unknown": given & complete & ~F.coalesce(relation.isin("current_session", "prior_session"), F.lit(False)),
        "reference_labels_conflict": given
        & complete
        & differs(c("reference")["calibration_created_in_current_session"], (relation == "current_session").cast("string")),
        "no_planned_runs": c("planned").isNull(),
        "unsound_planned_run": c("unsound_plan"),
        "plan_repeated": c("repeated_plan"),
        "run_assigned_twice": c("assigned_twice"),
        "run_listed_twice": c("listed_twice"),
        "run_assigned_not_listed": c("not_listed"),
        "run_listed_not_assigned": c("not_assigned"),
    }
    return rows.select("corpus_id", broken(rules).alias("problems"))


def planned_run_problems() -> Column:
    """Rules a planned run breaks. ``config`` is JSON text and must be an object."""
    c = F.col
    kind = F.schema_of_variant(F.try_parse_json("config"))
    rules = {f"missing_{n}": absent(n) for n in PLANNED_FIELDS}
    rules |= {
        "unknown_designation": ~F.coalesce(c("designation").isin(*DESIGNATIONS), F.lit(False)),
        "config_is_no_object": ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)),
        "negative_seed": F.coalesce(c("random_seed") < 0, F.lit(True)),
        "empty_config_id": c("workload_config_id") == "",
    }
    return broken(rules)


def coverage_record_problems(
    records: DataFrame, corpus_id: str, requested: Sequence[float], known_reasons: Sequence[str]
) -> DataFrame:
    """(plan_id, problems) of every coverage record, and of the records together: one plan has one
    record, all are of one corpus and of one list of requested windows.

    ``requested_windows`` is an array, ``rows_per_gpu`` and ``emitted_windows`` are maps from text to
    counts, ``sampling_gaps`` maps a device to a map of statistics, of which null ones are allowed. A
    count that is null is no count. Only plan ids are counted across rows.
    """
    if not requested or min(requested) <= 0:
        raise ValueError("windows must be positive")
    c = F.col
    devices = F.array(F.lit("0"), F.lit("1"))

    def keys_are(name: str, wanted: Column) -> Column:
        return F.coalesce(F.array_sort(F.map_keys(name)) == F.array_sort(wanted), F.lit(False))

    def no_count(name: str) -> Column:
        return F.exists(F.map_values(name), lambda v: F.coalesce(v < 0, F.lit(True)))

    labels = F.array_distinct(F.transform("requested_windows", lambda w: F.regexp_replace(w.cast("string"), r"\.0$", "")))
    gap = F.exists(F.map_values("sampling_gaps"), lambda d: F.exists(F.map_values(d), lambda v: F.coalesce(v < 0, F.lit(False))))
    start, end = c("common_start_ns"), c("common_end_ns")
    included, excluded = c("status") == "included", c("status") == "excluded"
    context = ("plan_id", "workload_family", "target_label", "experiment_session_id", "collection_id", "corpus_id", "node_id")
    unknown = ~F.coalesce(c("reason_code").isin(*known_reasons), F.lit(False))
    rules = {f"missing_{n}": absent(n) for n in context}
    rules |= {
        "unknown_status": ~F.coalesce(included | excluded, F.lit(False)),
        "included_with_reason": included & c("reason_code").isNotNull(),
        "excluded_without_known_reason": excluded & unknown,
        "windows_not_positive": F.coalesce(F.size("requested_windows") < 1, F.lit(True))
        | F.exists("requested_windows", lambda w: F.coalesce(w <= 0, F.lit(True))),
        "negative_duration": (c("common_overlap_seconds") < 0) | (c("usable_duration_seconds") < 0),
        "usable_exceeds_overlap": c("usable_duration_seconds") > c("common_overlap_seconds") + 1e-9,
        "negative_configuration": (c("configured_warmup_seconds") < 0) | (c("alignment_tolerance_seconds") < 0),
        "rows_not_of_both_devices": ~keys_are("rows_per_gpu", devices),
        "rows_no_count": no_count("rows_per_gpu"),
        "emitted_not_as_requested": ~keys_are("emitted_windows", labels),
        "emitted_no_count": no_count("emitted_windows"),
        "gaps_not_of_both_devices": ~keys_are("sampling_gaps", devices),
        "negative_gap": gap,
        "negative_pairs": F.coalesce(c("aligned_sample_pairs") < 0, F.lit(True)),
        "one_end_of_the_interval": start.isNull() != end.isNull(),
        "interval_reversed": end < start,
    }
    together = {
        "another_corpus": differs(c("corpus_id"), F.lit(corpus_id)),
        "other_windows": differs(c("requested_windows"), F.array(*[F.lit(float(w)) for w in requested])),
    }
    # Judged before the join, so that of a plan id with many records only the verdicts meet.
    judged = records.select("plan_id", broken(rules).alias("alone"), broken(together).alias("together"))
    copies = records.groupBy("plan_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = broken({"duplicate_plan": c("copies").isNotNull()})
    return judged.join(copies, "plan_id", "left").select("plan_id", F.concat("alone", shared, "together").alias("problems"))


def check_designations(selected: Sequence[str]) -> tuple[str, ...]:
    """The designations an extraction selects: known ones, each once, at least one."""
    if not selected or len(set(selected)) != len(selected) or not set(selected) <= set(DESIGNATIONS):
        raise ValueError("select each known designation once at most, and at least one")
    return tuple(selected)


def primary_rows(
    rows: DataFrame, adversarial: DataFrame | None = None, selected: Sequence[str] = ("adversarial",), seconds: float = 30.0
) -> DataFrame:
    """Feature rows of the primary window length with their ``partition``: benign ones are fitted,
    adversarial ones are only scored; all others fall out.

    ``adversarial`` is a second extraction, whose declared designations must be adversarial alone. Its
    columns may differ; what a side lacks is null. A row without a window length falls out.
    """
    if adversarial is not None:
        if set(check_designations(selected)) != {"adversarial"}:
            raise ValueError("the second extraction may hold adversarial runs alone")
        rows = rows.unionByName(adversarial, allowMissingColumns=True)
    primary = F.col("window_seconds") == float(seconds)
    wanted = reduce(or_, [F.col("designation") == d for d in ("benign", "adversarial")])
    return rows.where(primary & wanted).withColumn("partition", F.col("designation"))


def completion_matrix(plans: DataFrame, attempts: DataFrame, least_seconds: float = 30.0) -> DataFrame:
    """One row per planned run of the final corpus: its configuration, repetition, accepted run, state.

    A run is accepted where exactly one attempt of the plan is complete, valid and long enough; with
    several the plan is ``ambiguous`` and has none. The repetition is read from the JSON text of the
    configuration.
    """
    good = (
        (F.col("exit_status") == "completed")
        & F.col("participation_valid")
        & (F.coalesce("measured_duration_seconds", F.lit(0.0)) >= least_seconds)
    )
    per_plan = attempts.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(good).alias("good"), F.min(F.when(good, F.col("run_id"))).alias("run_id")
    )
    state = (
        F.when(F.col("good") == 1, "completed")
        .when(F.col("good") > 1, "ambiguous")
        .when(F.col("attempts") > 0, "failed")
        .otherwise("not_started")
    )
    return plans.join(per_plan, "plan_id", "left").select(
        "corpus_id",
        "plan_id",
        "workload_family",
        F.col("workload_config_id").alias("configuration_id"),
        F.get_json_object("config", "$.repetition").try_cast("long").alias("repetition"),
        state.alias("state"),
        F.when(state == "completed", F.col("run_id")).alias("accepted_run_id"),
        (state == "completed").alias("completed"),
    )


def corpus_acceptance(
    matrix: DataFrame, families: Sequence[str], minimum_runs: int, smoke_only: Column | None = None
) -> DataFrame:
    """Per corpus of a :func:`completion_matrix`: launched and failed runs, families short of
    ``minimum_runs``, whether the gate passed, and whether the corpus is accepted.

    A development smoke run (``smoke_only``, by default none) is never eligible, whatever its gate says.
    """
    if minimum_runs < 1 or not families:
        raise ValueError("the gate needs a family and a run")
    done = F.col("completed")
    by_family = matrix.groupBy("corpus_id", "workload_family").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(done).alias("done"), F.count_if(F.col("state") == "failed").alias("failed")
    )
    wanted = F.array(*map(F.lit, families))
    # At most one entry for each required family.
    enough = F.collect_set(F.when((F.col("done") >= minimum_runs) & F.col("workload_family").isin(*families), F.col("workload_family")))
    found = by_family.groupBy("corpus_id").agg(
        F.sum("planned").alias("planned"),
        F.sum("done").alias("launch_completed_count"),
        F.sum("failed").alias("launch_failed_count"),
        F.array_sort(F.array_except(wanted, enough)).alias("short"),
    )
    passed, eligible = F.size("short") == 0, ~(F.lit(False) if smoke_only is None else F.coalesce(smoke_only, F.lit(False)))
    return found.select(
        "corpus_id",
        "planned",
        "launch_completed_count",
        "launch_failed_count",
        F.array_join("short", ",").alias("families_short"),
        passed.alias("gate_passed"),
        eligible.alias("scientific_acceptance_eligible"),
        (passed & eligible).alias("accepted"),
        F.when(passed & eligible, "accepted").otherwise("not_accepted").alias("scientific_acceptance_state"),
    )
