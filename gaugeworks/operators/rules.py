"""Evidence rules: every rejected row keeps the names of the rules it broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.arrays import once
from gaugeworks.operators.ingest import ZONED
from gaugeworks.schemas import (
    CURRENT_VERSION,
    DESIGNATIONS,
    EXIT_STATUSES,
    LEGACY_TELEMETRY_FIELDS,
    LEGACY_VERSION,
    PCIE_MULTIPLIER,
    PCIE_RAW_UNIT,
    SCHEMA_VERSIONS,
    TELEMETRY_FIELDS,
    FIELD_UNITS,
)

RANK_EVIDENCE = (
    "map<string,struct<strategy_summary:struct<actual_sync_rounds:bigint,expected_sync_rounds:bigint,"
    "communication_bytes_proxy:double,throughput_tokens_per_s:double,final_loss_proxy:double,detector_score:double>,"
    "memory_peak:struct<allocated_bytes:bigint>>>"
)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their given order. A null condition does not fire."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def empty(column: str) -> Column:
    return F.coalesce(F.length(column) == 0, F.lit(True))


def zone_missing(column: str) -> Column:
    return ~F.coalesce(F.col(column).rlike(ZONED), F.lit(False))


def manifest_rules() -> dict[str, Column]:
    """Run manifest rules, from identity to the measured interval of completed current runs."""
    c = F.col
    current = c("schema_version") == CURRENT_VERSION
    measured = current & (c("exit_status") == "completed") & c("participation_valid")
    start, end = c("measurement_start_ns"), c("measurement_end_ns")
    span = (end - start) / F.lit(1e9)
    return {
        "unsupported_version": ~c("schema_version").isin(*SCHEMA_VERSIONS),
        "empty_run_id": empty("run_id"),
        "empty_environment_fingerprint": empty("environment_fingerprint"),
        "empty_source_commit": empty("source_commit"),
        "negative_warmup": c("warmup_seconds") < 0,
        "world_size_not_two": c("world_size") != 2,
        "unknown_designation": ~c("designation").isin(*DESIGNATIONS),
        "unknown_exit_status": ~c("exit_status").isin(*EXIT_STATUSES),
        "start_without_zone": zone_missing("started_at_utc"),
        "failure_without_reason": (c("exit_status") != "completed") & empty("failure_reason"),
        "missing_session": current & empty("experiment_session_id"),
        "missing_corpus": current & empty("corpus_id"),
        "seed_mismatch": current & (c("random_seed") != c("seed")),
        "missing_measurement": measured & (start.isNull() | end.isNull()),
        "unordered_measurement": measured & ((start < 0) | (end < start)),
        "duration_mismatch": measured & (F.abs(c("measured_duration_seconds") - span) > 1e-6),
    }


def rank_evidence(manifests: DataFrame) -> DataFrame:
    """One row per (run, rank) of the evidence nested in ``config``."""
    evidence = F.from_json(F.get_json_object("config", "$.rank_runtime_evidence"), RANK_EVIDENCE)
    return manifests.select("run_id", "workload_family", F.explode(evidence).alias("rank", "e")).select(
        "run_id",
        "workload_family",
        "rank",
        "e.strategy_summary.*",
        F.col("e.memory_peak.allocated_bytes").alias("allocated_bytes"),
    )


def rank_evidence_problems(manifests: DataFrame) -> DataFrame:
    """Problems of completed adversarial runs: rounds, agreement of ranks, finite metrics, no score.

    A loss may be null. A run without any evidence has a row too: both its ranks are missing.
    """
    wanted = manifests.where(
        (F.col("designation") == "adversarial")
        & (F.col("exit_status") == "completed")
        & F.col("participation_valid")
        & (F.col("schema_version") == CURRENT_VERSION)
    )
    facts = rank_evidence(wanted).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("ranks"),
        F.min("actual_sync_rounds").alias("low"),
        F.max("actual_sync_rounds").alias("high"),
        F.bool_or(F.col("actual_sync_rounds") != F.col("expected_sync_rounds")).alias("off"),
        F.bool_or(F.isnan("final_loss_proxy") | (F.abs("final_loss_proxy") == float("inf"))).alias("gap"),
        F.bool_or(F.col("detector_score").isNotNull()).alias("scored"),
    )
    rules = {
        "rank_missing": F.coalesce(F.col("ranks"), F.lit(0)) != 2,
        "rounds_not_as_expected": F.col("off"),
        "ranks_disagree": F.col("low") != F.col("high"),
        "metric_not_finite": F.col("gap"),
        "score_present": F.col("scored"),
    }
    every = wanted.select("run_id").distinct().join(facts, "run_id", "left")
    return every.select("run_id", violations(rules).alias("violations"))


# --- fixed values: names inside the evidence of a rank ---
EVIDENCE_COUNTS = ("communication_bytes_proxy", "optimizer_steps", "inference_steps", "processed_tokens")
EVIDENCE_METRICS = ("throughput_tokens_per_s", "final_loss_proxy", "detector_score")
EVIDENCE_TEXTS = ("strategy_id", "communication_proxy_definition", "detector_score_status")
UNSCORED = "pending_frozen_evaluation"
SUMMARY_VALUES = (
    "actual_sync_rounds", "expected_sync_rounds", *EVIDENCE_COUNTS, *EVIDENCE_METRICS, "wall_time_s", *EVIDENCE_TEXTS, "detector_model",
    "parameter_state_agreement",
)
MEMORY_VALUES = ("allocated_bytes", "reserved_bytes")
# ---------------------------------------------------------


def rank_evidence_audit(manifests: DataFrame) -> DataFrame:
    """Every problem of the rank evidence of completed adversarial runs, rank by rank and between ranks.

    ``config`` is parsed once as a variant, which keeps the types of its values apart: 1.0 is no
    count and true is no number. Null, and a text that is no JSON, are a run without evidence. A rank
    without a summary has that problem alone. No shuffle: both ranks are in one row.
    """
    current = F.col("schema_version") == CURRENT_VERSION
    done = current & (F.col("designation") == "adversarial") & (F.col("exit_status") == "completed") & F.col("participation_valid")
    rows = manifests.where(done).select("run_id", "workload_label", F.try_parse_json("config").alias("parsed"))
    ranks, evidence = ("0", "1"), "$.rank_runtime_evidence"

    def part(value: Column | str, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(value, path, kind)

    # Step by step down into the value, each step behind ``once``: no rule walks or types it again.
    keys = F.map_keys(part("parsed", evidence, "map<string,variant>"))
    rows = once(rows, keys=keys, strategy=part("parsed", "$.strategy_id"), evidence=part("parsed", evidence)).drop("parsed")
    rows = once(
        rows,
        **{f"summary_{r}": part("evidence", f'$["{r}"].strategy_summary') for r in ranks},
        **{f"memory_{r}": part("evidence", f'$["{r}"].memory_peak') for r in ranks},
    ).drop("evidence")
    leaves = {f"{name}_{r}": part(f"summary_{r}", f"$.{name}") for r in ranks for name in SUMMARY_VALUES}
    leaves |= {f"{name}_{r}": part(f"memory_{r}", f"$.{name}") for r in ranks for name in MEMORY_VALUES}
    rows = once(rows, **leaves)
    kinds = {f"kind_{name}": F.coalesce(F.schema_of_variant(name), F.lit("VOID")) for name in (*leaves, "strategy")}
    kinds |= {f"whole_{r}": F.coalesce(F.schema_of_variant(f"summary_{r}"), F.lit("VOID")).startswith("OBJECT") for r in ranks}
    rows = once(rows, **kinds)

    def kind_of(name: str) -> Column:
        return F.col(f"kind_{name}")

    def whole_number(name: str) -> Column:
        """A whole number of zero or more, else null."""
        value = part(name, "$", "bigint")
        return F.when((kind_of(name) == "BIGINT") & (value >= 0), value)

    def number(name: str) -> Column:
        """Whether there is a finite number of zero or more."""
        value = part(name, "$", "double")
        numeric = kind_of(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        return F.coalesce(numeric & (value >= 0) & (value < float("inf")), F.lit(False))

    def filled_text(name: str) -> Column:
        value = part(name, "$", "string")
        return F.when((kind_of(name) == "STRING") & (value != ""), value)

    numbers = ("actual_sync_rounds", "expected_sync_rounds", *EVIDENCE_COUNTS, *MEMORY_VALUES)
    typed = {f"whole_{n}_{r}": whole_number(f"{n}_{r}") for r in ranks for n in numbers}
    typed |= {f"number_{n}_{r}": number(f"{n}_{r}") for r in ranks for n in (*EVIDENCE_METRICS, "wall_time_s")}
    typed |= {f"text_{n}_{r}": filled_text(f"{n}_{r}") for r in ranks for n in EVIDENCE_TEXTS}
    typed |= {f"agreed_{r}": part(f"parameter_state_agreement_{r}", "$", "boolean") for r in ranks}
    rows = once(rows, **typed, text_strategy=filled_text("strategy"))
    c = F.col
    exact = F.coalesce(F.array_sort("keys") == F.array(F.lit("0"), F.lit("1")), F.lit(False))
    problems = [F.when(~exact, "ranks_not_zero_and_one")]
    for r in ranks:
        actual, expected = c(f"whole_actual_sync_rounds_{r}"), c(f"whole_expected_sync_rounds_{r}")
        rules = {"sync_counts_invalid": actual.isNull() | expected.isNull(), "sync_counts_differ": actual != expected}
        rules |= {f"{n}_invalid": c(f"whole_{n}_{r}").isNull() for n in EVIDENCE_COUNTS}
        rules |= {f"{n}_invalid": (kind_of(f"{n}_{r}") != "VOID") & ~c(f"number_{n}_{r}") for n in EVIDENCE_METRICS}
        rules["wall_time_s_invalid"] = ~c(f"number_wall_time_s_{r}")
        rules |= {f"{n}_empty": c(f"text_{n}_{r}").isNull() for n in EVIDENCE_TEXTS}
        rules["strategy_mismatch"] = ~c(f"text_strategy_id_{r}").eqNullSafe(c("text_strategy"))
        scored = (kind_of(f"detector_score_{r}") != "VOID") | (kind_of(f"detector_model_{r}") != "VOID")
        rules["scored_at_run_time"] = scored | ~c(f"text_detector_score_status_{r}").eqNullSafe(F.lit(UNSCORED))
        rules["memory_peak_invalid"] = c(f"whole_allocated_bytes_{r}").isNull() | c(f"whole_reserved_bytes_{r}").isNull()
        agreed = (kind_of(f"parameter_state_agreement_{r}") == "BOOLEAN") & c(f"agreed_{r}")
        rules["parameters_disagree"] = (c("workload_label") == "training") & ~F.coalesce(agreed, F.lit(False))
        whole = c(f"whole_{r}")
        problems.append(F.when(~whole, f"rank_{r}_summary_missing"))
        problems += [F.when(whole & rule, f"rank_{r}_{name}") for name, rule in rules.items()]
    problems.append(F.when(c("whole_actual_sync_rounds_0") != c("whole_actual_sync_rounds_1"), "ranks_disagree_on_rounds"))
    return rows.select("run_id", F.array_compact(F.array(*problems)).alias("problems"))


def migrate_legacy(manifests: DataFrame) -> DataFrame:
    """Non-destructive 2.0 view of 1.0 rows, marked so that they are never used for splits."""
    legacy = F.col("schema_version") == LEGACY_VERSION
    return manifests.withColumns(
        {
            "original_schema_version": F.col("schema_version"),
            "legacy_grouping_ambiguous": legacy,
            "experiment_session_id": F.when(~legacy, F.col("experiment_session_id")),
            "schema_version": F.when(legacy, CURRENT_VERSION).otherwise(F.col("schema_version")),
        }
    )


def reading_rules(value: Column, unit: Column, supported: Column, error: Column, name: Column) -> dict[str, Column]:
    """A supported reading has a finite value and no error; an unsupported one the reverse."""
    units = F.create_map(*[x for n, u in FIELD_UNITS.items() for x in (F.lit(n), F.lit(u))])
    return {
        "missing_unit": F.coalesce(F.length(unit) == 0, F.lit(True)),
        "unexpected_unit": ~unit.eqNullSafe(F.try_element_at(units, name)),
        "supported_with_error": supported & error.isNotNull(),
        "supported_without_value": supported & value.isNull(),
        "not_finite": supported & (F.isnan(value) | (F.abs(value) == float("inf"))),
        "unsupported_with_value": ~supported & value.isNotNull(),
        "unsupported_without_reason": ~supported & F.coalesce(F.length(error) == 0, F.lit(True)),
    }


def sample_rules() -> dict[str, Column]:
    """Rules of one telemetry sample record (schema ``TELEMETRY_SAMPLE``)."""
    c = F.col
    current = c("schema_version") == CURRENT_VERSION
    names = F.array_sort(F.map_keys("fields"))
    full = names == F.array(*[F.lit(f) for f in sorted(TELEMETRY_FIELDS)])
    nine = names == F.array(*[F.lit(f) for f in sorted(LEGACY_TELEMETRY_FIELDS)])
    broken = F.exists(
        F.map_entries("fields"),
        lambda e: F.size(
            violations(
                reading_rules(
                    e["value"]["value"],
                    e["value"]["unit"],
                    F.coalesce(e["value"]["supported"], F.lit(False)),
                    e["value"]["error"],
                    e["key"],
                )
            )
        )
        > 0,
    )

    def negative(column: str) -> Column:
        return F.coalesce(c(column) < 0, F.lit(False)) | F.coalesce(F.isnan(column), F.lit(False))

    return {
        "unsupported_version": ~F.coalesce(c("schema_version").isin(*SCHEMA_VERSIONS), F.lit(False)),
        "empty_run_id": empty("run_id"),
        "negative_gpu_index": F.coalesce(c("gpu_index") < 0, F.lit(True)),
        "negative_sequence": F.coalesce(c("sequence") < 0, F.lit(True)),
        "negative_monotonic_ns": F.coalesce(c("monotonic_ns") < 0, F.lit(True)),
        "time_without_zone": zone_missing("wall_time_utc"),
        "unexpected_fields": ~F.coalesce(
            full | (nine & (c("schema_version") == LEGACY_VERSION)), F.lit(False)
        ),
        "invalid_reading": broken,
        "target_interval_not_positive": current
        & ~F.coalesce(c("target_sampling_interval_s") > 0, F.lit(False)),
        "invalid_interval": current & negative("actual_sampling_interval_s"),
        "invalid_jitter": current & negative("sampling_jitter_s"),
        "invalid_rank": current & F.coalesce(c("rank") < 0, F.lit(True)),
        "invalid_process": current & F.coalesce(c("process_id") <= 0, F.lit(True)),
        "raw_unit_not_preserved": current
        & ~F.coalesce(
            (F.try_element_at("raw_unit_metadata", F.lit("pcie_nvml_raw_unit")) == PCIE_RAW_UNIT)
            & (
                F.try_element_at("raw_unit_metadata", F.lit("pcie_bytes_multiplier"))
                == str(PCIE_MULTIPLIER)
            ),
            F.lit(False),
        ),
    }


def convert_raw_counters(raw: DataFrame) -> DataFrame:
    """Raw device counters in standard units: KB/s to bytes/s, milliwatts to watts."""
    return raw.withColumns(
        {
            "pcie_tx_bytes_per_s": F.col("pcie_tx_kb_per_s") * PCIE_MULTIPLIER,
            "pcie_rx_bytes_per_s": F.col("pcie_rx_kb_per_s") * PCIE_MULTIPLIER,
            "power_draw_w": F.col("power_draw_mw") / F.lit(1000.0),
        }
    )


# --- fixed values: texts in a log and the category they stand for, first match wins ---
LOG_CATEGORIES = (
    ("out of memory", "cuda_out_of_memory"),
    ("rendezvous", "rendezvous_or_port_failure"),
    ("address already in use", "rendezvous_or_port_failure"),
    ("nccl", "process_group_or_nccl_failure"),
)
TIMEOUT_CATEGORY = "nccl_timeout_or_collective_mismatch"
PARTICIPATION_CATEGORY = "rank_crash_or_asymmetric_exit"
EXIT_CATEGORY = "workload_failure"
SAMPLER_CATEGORY = "telemetry_sampler_failure"
# ---------------------------------------------------------------------------------------


def failure_category() -> Column:
    """Category of a launch from flags and log text; a sampler error overrides all others."""
    c = F.col
    log = F.lower(F.concat_ws("\n", "stderr", "stdout"))
    category = F.when(F.length("collector_error") > 0, SAMPLER_CATEGORY).when(c("timed_out"), TIMEOUT_CATEGORY)
    for text, name in LOG_CATEGORIES:
        category = category.when(log.contains(text), name)
    return category.when(~c("participation_valid"), PARTICIPATION_CATEGORY).when(c("return_code") != 0, EXIT_CATEGORY)


def exit_status() -> Column:
    c = F.col
    clean = (c("return_code") == 0) & c("participation_valid") & c("collector_error").isNull()
    return F.when(c("timed_out"), "timeout").when(clean, "completed").otherwise("failed")


def readiness() -> Column:
    """All-of gate of an environment row: two matching, distinct devices and a working stack."""
    c = F.col
    return F.coalesce(
        (c("device_count") == 2)
        & c("models_match")
        & (c("uuid_0") != c("uuid_1"))
        & c("driver_ok")
        & c("backend_ok"),
        F.lit(False),
    )


def identity_hash(config_json: Column) -> Column:
    """First sixteen hex digits of the SHA-256 of canonical configuration text."""
    return F.substring(F.sha2(config_json, 256), 1, 16)


def identifier(text: Column) -> Column:
    """Letters, digits, dot, underscore and dash, without dots and dashes at the ends; null where
    nothing is left, which is no identifier."""
    kept = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "-")
    return F.nullif(F.regexp_replace(kept, r"^[-.]+|[-.]+$", ""), F.lit(""))


def safe_relative_path(path: Column) -> Column:
    """Relative, without any ".." step."""
    return (
        (F.length(path) > 0)
        & ~path.startswith("/")
        & ~F.array_contains(F.split(path, "/"), F.lit(".."))
    )


def corpus_problems(plans: DataFrame, accepted: DataFrame) -> DataFrame:
    """Plan and acceptance defects: duplicates, and ids on only one side of plan and allow-list."""
    repeated = plans.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    assigned = plans.where("accepted_run_id IS NOT NULL").groupBy("accepted_run_id").agg(
        F.count(F.lit(1)).alias("plans")
    )
    listed = accepted.groupBy(F.col("run_id").alias("accepted_run_id")).agg(
        F.count(F.lit(1)).alias("listings")
    )
    sides = assigned.join(listed, "accepted_run_id", "full_outer")
    kind = (
        F.when(F.col("listings").isNull(), "assigned_not_listed")
        .when(F.col("plans").isNull(), "listed_not_assigned")
        .when(F.col("plans") > 1, "assigned_twice")
        .when(F.col("listings") > 1, "listed_twice")
    )
    return repeated.select(F.lit("duplicate_plan").alias("problem"), F.col("plan_id").alias("item")).unionByName(
        sides.select(kind.alias("problem"), F.col("accepted_run_id").cast("string").alias("item")).where(
            "problem IS NOT NULL"
        )
    )


def with_scope(rows: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Adds fixed scope columns; rows already carrying another value are marked, not overwritten."""
    conflict = F.lit(False)
    for name, value in scope.items():
        if name in rows.columns:
            conflict |= F.col(name).isNotNull() & (F.col(name) != value)
    marked = rows.withColumn("scope_conflict", conflict)
    return marked.withColumns(
        {
            name: F.coalesce(name, F.lit(value)) if name in rows.columns else F.lit(value)
            for name, value in scope.items()
        }
    )
