"""Contracts: strategies, registry, profiles, corpora, coverage records, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.registry import query
from gaugeworks.operators import rules as R
from gaugeworks.plans import contracts as C
from gaugeworks.plans.matrix import STRATEGIES, STRATEGY_BOUNDS
from gaugeworks.schemas import COVERAGE_REASONS, FIELD_UNITS
from gaugeworks.sources import contract_views  # noqa: F401  (adds the views)
from gaugeworks.sources.views import VIEWS, view

WINDOWS = (5.0, 15.0, 30.0)
GATE_FAMILIES = ("ddp_training", "inference_synchronized", "control_idle")
# The SQL calls the workload registry plainly registry; the view of that name holds the agents.
EXTRA: dict[str, str] = {"registry": VIEWS["workload_registry"]}


def joined(frame: DataFrame) -> DataFrame:
    return frame.withColumn("problems", F.array_join("problems", ","))


def _texts(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _cases(rules: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items()) + ")"


def _bounds(name: str, low: float, high: float, whole: bool, where: str) -> dict[str, str]:
    inside = f"{name} >= {low} AND {name} <= {high}"
    rules = {f"{name}_out_of_bounds": f"{where} AND NOT ({inside})"}
    if whole:
        rules[f"{name}_not_integral"] = f"{where} AND {inside} AND {name} <> trunc({name})"
    return rules


def _contract(position: int) -> str:
    return "CASE strategy_id " + " ".join(f"WHEN '{row[0]}' THEN '{row[position]}'" for row in C.STRATEGY_CONTRACTS) + " END"


_RULES = {
    "family_mismatch": "family IS DISTINCT FROM strategy_id",
    "label_mismatch": f"label IS DISTINCT FROM {_contract(1)}",
    "mode_mismatch": f"mode IS DISTINCT FROM {_contract(2)}",
    "designation_not_adversarial": "designation IS DISTINCT FROM 'adversarial'",
    "enabled_by_default": "enabled_by_default IS DISTINCT FROM false",
    "approval_not_required": "requires_human_approval IS DISTINCT FROM true",
}
for _strategy, _name, _low, _high, _whole in STRATEGY_BOUNDS:
    _RULES[f"{_name}_missing"] = f"strategy_id = '{_strategy}' AND {_name} IS NULL"
    _RULES |= _bounds(_name, _low, _high, _whole, f"strategy_id = '{_strategy}'")
for _name, _low, _high, _whole in C.COMMON_BOUNDS:
    _RULES |= _bounds(_name, _low, _high, _whole, "true")
_RULES |= {
    "hidden_size_not_divisible_by_heads": "hidden_size % nullif(heads, 0) <> 0",
    "precision_unknown": f"precision NOT IN ({_texts(C.PRECISIONS)})",
    "duration_is_not_the_segment": "strategy_id = 'segmented_runs' AND coalesce(min_measured_seconds, 0) <> segment_seconds",
    "duration_out_of_range": "strategy_id <> 'segmented_runs' AND (coalesce(min_measured_seconds, 0) < 35 OR min_measured_seconds > 60)",
}
_STRATEGY = f"CASE WHEN strategy_id IN ({_texts(STRATEGIES)}) THEN {_cases(_RULES)} ELSE 'unknown_strategy' END"


@query(
    "strategy_contract",
    "P-21",
    f"SELECT entry_id, {_STRATEGY} AS problems FROM {{registry}} WHERE strategy_id IS NOT NULL OR designation = 'adversarial'",
    EXTRA,
)
def strategy_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(C.judge_strategies(view(spark, sf_dir, "workload_registry")))


_REGISTRY = {f"missing_{n}": f"coalesce({n}, '') = ''" for n in C.REGISTRY_FIELDS}
_REGISTRY |= {
    "shared_config_id": "config_id <> '' AND count(*) OVER (PARTITION BY config_id) > 1",
    "negative_warmup": "designation = 'benign' AND (warmup_seconds IS NULL OR warmup_seconds < 0)",
    "measured_too_short": """(designation = 'benign' AND coalesce(min_measured_seconds, 0) < 35) OR (designation = 'adversarial'
       AND coalesce(min_measured_seconds, 0) < CASE WHEN strategy_id = 'segmented_runs' THEN segment_seconds ELSE 35 END)""",
    "estimate_too_short": """designation IN ('benign', 'adversarial')
       AND coalesce(estimated_seconds, 0) < coalesce(warmup_seconds, 0) + coalesce(min_measured_seconds, 0)""",
}
_REGISTRY |= {f"{n}_above_limit": f"designation = 'benign' AND trunc({n}) > {most}" for n, most in C.BENIGN_LIMITS}


@query(
    "registry_contract",
    "G-03",
    f"""SELECT entry_id, concat_ws(',', nullif({_cases(_REGISTRY)}, ''), CASE WHEN designation = 'adversarial' THEN nullif({_STRATEGY}, '') END) AS problems
        FROM {{registry}}""",
    EXTRA,
)
def registry_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(C.judge_registry(view(spark, sf_dir, "workload_registry")))


@query(
    "registry_gaps",
    "G-03 J-06",
    f"""SELECT 'registry' AS scope, f AS item, 'missing_family' AS problem FROM (SELECT unnest([{_texts(C.BENIGN_FAMILIES)}]) AS f) w
        WHERE f NOT IN (SELECT family FROM {{registry}} WHERE designation = 'benign')
        UNION SELECT profile, workload_name, 'unknown_workload' FROM {{profiles}} WHERE workload_name NOT IN (SELECT workload_name FROM {{registry}})
        UNION SELECT profile, family, 'foreign_family' FROM {{profiles}} JOIN {{registry}} USING (workload_name) WHERE adversarial AND family NOT IN ({_texts(STRATEGIES)})
        UNION SELECT profile, f, 'missing_strategy' FROM (SELECT DISTINCT profile FROM {{profiles}} WHERE adversarial) a,
          (SELECT unnest([{_texts(STRATEGIES)}]) AS f) s
          WHERE NOT EXISTS (SELECT 1 FROM {{profiles}} p JOIN {{registry}} r USING (workload_name) WHERE p.profile = a.profile AND r.family = s.f)""",
    EXTRA,
)
def registry_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.registry_gaps(view(spark, sf_dir, "workload_registry"), view(spark, sf_dir, "profiles"))


_PLANNED = {f"missing_{n}": f"coalesce({n}, '') = ''" for n in C.PLANNED_FIELDS}
_PLANNED |= {
    "unknown_designation": "designation IS NULL OR designation NOT IN ('benign', 'adversarial', 'calibration')",
    "config_is_no_object": "config IS NULL OR NOT json_valid(config) OR json_type(CASE WHEN json_valid(config) THEN config END) <> 'OBJECT'",
    "negative_seed": "random_seed IS NULL OR random_seed < 0",
    "empty_config_id": "workload_config_id = ''",
}


@query("planned_run_rules", "P-25", f"SELECT corpus_id, entry, {_cases(_PLANNED)} AS problems FROM {{corpus_plans}}", EXTRA)
def planned_run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = view(spark, sf_dir, "corpus_plans")
    return joined(plans.select("corpus_id", "entry", C.planned_run_problems().alias("problems")))


def _ref(name: str) -> str:
    return f"json_extract_string(CASE WHEN json_valid(calibration_reference) THEN calibration_reference END, '$.{name}')"


_WHOLE = " AND ".join(f"{_ref(n)} IS NOT NULL" for n in C.REFERENCE_FIELDS)
_HEX = "'^[0-9a-f]{{64}}$'".replace("{{", "{").replace("}}", "}")
_MINE = "(SELECT {0} FROM {{{1}}} x WHERE x.corpus_id = c.corpus_id {2})"
_CORPUS = {"unsupported_version": "schema_version IS DISTINCT FROM '2.0'"}
_CORPUS |= {f"missing_{n}": f"coalesce({n}, '') = ''" for n in C.CORPUS_FIELDS}
_CORPUS |= {
    "wrong_kind": "artifact_kind IS DISTINCT FROM 'corpus_manifest'",
    "source_dirty_unknown": "source_dirty IS NULL",
    "negative_seed": "random_seed IS NULL OR random_seed < 0",
    "archive_digest_malformed": f"NOT regexp_matches(input_archive_sha256, {_HEX})",
    "reference_incomplete": f"calibration_reference IS NOT NULL AND NOT ({_WHOLE})",
    "reference_path_invalid": f"""{_WHOLE} AND ({_ref("calibration_artifact_path")} = '' OR starts_with({_ref("calibration_artifact_path")}, '/')
       OR list_contains(string_split({_ref("calibration_artifact_path")}, '/'), '..'))""",
    "reference_digest_malformed": f"{_WHOLE} AND NOT regexp_matches({_ref('calibration_sha256')}, {_HEX})",
    "reference_relationship_unknown": f"{_WHOLE} AND {_ref('calibration_relationship')} NOT IN ('current_session', 'prior_session')",
    "reference_labels_conflict": f"""{_WHOLE} AND ({_ref("calibration_created_in_current_session")} = 'true') <> ({_ref("calibration_relationship")} = 'current_session')""",
    "no_planned_runs": "corpus_id NOT IN (SELECT corpus_id FROM {corpus_plans})",
    "unsound_planned_run": "corpus_id IN (SELECT corpus_id FROM {judged_plans} WHERE problems <> '')",
    "plan_repeated": "corpus_id IN (SELECT corpus_id FROM {corpus_plans} GROUP BY corpus_id, plan_id HAVING count(*) > 1)",
    "run_assigned_twice": "corpus_id IN (SELECT corpus_id FROM {corpus_plans} WHERE accepted_run_id IS NOT NULL GROUP BY corpus_id, accepted_run_id HAVING count(*) > 1)",
    "run_listed_twice": "corpus_id IN (SELECT corpus_id FROM {corpus_accepted} GROUP BY corpus_id, run_id HAVING count(*) > 1)",
    "run_assigned_not_listed": """corpus_id IN (SELECT corpus_id FROM {corpus_plans} p WHERE accepted_run_id IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM {corpus_accepted} a WHERE a.corpus_id = p.corpus_id AND a.run_id = p.accepted_run_id))""",
    "run_listed_not_assigned": """corpus_id IN (SELECT corpus_id FROM {corpus_accepted} a WHERE NOT EXISTS
       (SELECT 1 FROM {corpus_plans} p WHERE a.corpus_id = p.corpus_id AND a.run_id = p.accepted_run_id))""",
}
EXTRA["judged_plans"] = f"SELECT corpus_id, {_cases(_PLANNED)} AS problems FROM {{corpus_plans}}"


@query("corpus_contract", "P-25 X-03", f"SELECT corpus_id, {_cases(_CORPUS)} AS problems FROM {{corpora}}", EXTRA)
def corpus_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.judge_corpora(
        view(spark, sf_dir, "corpora"), view(spark, sf_dir, "corpus_plans"), view(spark, sf_dir, "corpus_accepted")
    )
    return joined(found)


def _negative(column: str) -> str:
    return f"""len([x for x in json_keys({column}) if coalesce(CAST(json_extract_string({column}, '$."' || x || '"') AS BIGINT) < 0, true)]) > 0"""


_CONTEXT = ("plan_id", "workload_family", "target_label", "experiment_session_id", "collection_id", "corpus_id", "node_id")
_COVERAGE = {f"missing_{n}": f"coalesce({n}, '') = ''" for n in _CONTEXT}
_COVERAGE |= {
    "unknown_status": "status IS NULL OR status NOT IN ('included', 'excluded')",
    "included_with_reason": "status = 'included' AND reason_code IS NOT NULL",
    "excluded_without_known_reason": f"status = 'excluded' AND (reason_code IS NULL OR reason_code NOT IN ({_texts(COVERAGE_REASONS)}))",
    "windows_not_positive": "coalesce(len(w), 0) = 0 OR list_min(w) <= 0",
    "negative_duration": "common_overlap_seconds < 0 OR usable_duration_seconds < 0",
    "usable_exceeds_overlap": "usable_duration_seconds > common_overlap_seconds + 0.000000001",
    "negative_configuration": "configured_warmup_seconds < 0 OR alignment_tolerance_seconds < 0",
    "rows_not_of_both_devices": "coalesce(list_sort(json_keys(rows_per_gpu)), []) <> ['0', '1']",
    "rows_no_count": _negative("rows_per_gpu"),
    "emitted_not_as_requested": "list_sort(json_keys(emitted_windows)) IS DISTINCT FROM list_sort([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in w])",
    "emitted_no_count": _negative("emitted_windows"),
    "gaps_not_of_both_devices": "coalesce(list_sort(json_keys(sampling_gaps)), []) <> ['0', '1']",
    "negative_gap": "contains(sampling_gaps, ':-')",
    "negative_pairs": "aligned_sample_pairs IS NULL OR aligned_sample_pairs < 0",
    "one_end_of_the_interval": "(common_start_ns IS NULL) <> (common_end_ns IS NULL)",
    "interval_reversed": "common_end_ns < common_start_ns",
    "duplicate_plan": "count(*) OVER (PARTITION BY plan_id) > 1",
    "another_corpus": "corpus_id IS DISTINCT FROM 'corpus-main'",
    "other_windows": "w IS DISTINCT FROM CAST([5, 15, 30] AS DOUBLE[])",
}


@query(
    "coverage_record_rules",
    "A-33",
    f"SELECT plan_id, {_cases(_COVERAGE)} AS problems FROM (SELECT *, CAST(CAST(requested_windows AS JSON) AS DOUBLE[]) AS w FROM {{coverage_evidence}}) c",
    EXTRA,
)
def coverage_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = "map<string,bigint>"
    records = view(spark, sf_dir, "coverage_evidence").withColumns(
        {
            "requested_windows": F.from_json("requested_windows", "array<double>"),
            "rows_per_gpu": F.from_json("rows_per_gpu", counts),
            "emitted_windows": F.from_json("emitted_windows", counts),
            "sampling_gaps": F.from_json("sampling_gaps", "map<string,map<string,double>>"),
        }
    )
    return joined(C.coverage_record_problems(records, "corpus-main", WINDOWS, COVERAGE_REASONS))


# --- final corpus, acceptance, partitions ------------------------------------------
EXTRA["final_corpus"] = """
SELECT corpus_id, entry AS plan_id, workload_family, workload_config_id AS configuration_id,
       TRY_CAST(json_extract_string(CASE WHEN json_valid(config) THEN config END, '$.repetition') AS BIGINT) AS repetition,
       CASE WHEN good = 1 THEN 'completed' WHEN good > 1 THEN 'ambiguous' WHEN attempts > 0 THEN 'failed' ELSE 'not_started' END AS state,
       CASE WHEN good = 1 THEN run_id END AS accepted_run_id, coalesce(good = 1, false) AS completed
FROM {corpus_plans} p LEFT JOIN (
  SELECT plan_id, count(*) AS attempts, count(*) FILTER (WHERE ok) AS good, min(run_id) FILTER (WHERE ok) AS run_id
  FROM (SELECT *, exit_status = 'completed' AND participation_valid AND coalesce(measured_duration_seconds, 0) >= 30 AS ok FROM {plan_attempts}) t
  GROUP BY plan_id) a ON a.plan_id = p.entry
"""


def final_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = view(spark, sf_dir, "corpus_plans").drop("plan_id").withColumnRenamed("entry", "plan_id")
    return C.completion_matrix(plans, view(spark, sf_dir, "plan_attempts"))


@query("completion_matrix", "A-43 G-04", "SELECT * FROM {final_corpus}", EXTRA)
def completion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_corpus(spark, sf_dir)


_SHORT = [
    f"CASE WHEN count(*) FILTER (WHERE completed AND workload_family = '{f}') < 1 THEN '{f}' END" for f in sorted(GATE_FAMILIES)
]


@query(
    "corpus_acceptance",
    "P-26",
    f"""SELECT *, families_short = '' AS gate_passed, NOT smoke AS scientific_acceptance_eligible, families_short = '' AND NOT smoke AS accepted,
               CASE WHEN families_short = '' AND NOT smoke THEN 'accepted' ELSE 'not_accepted' END AS scientific_acceptance_state
        FROM (SELECT corpus_id, count(*) AS planned, count(*) FILTER (WHERE completed) AS launch_completed_count,
                     count(*) FILTER (WHERE state = 'failed') AS launch_failed_count, concat_ws(',', {", ".join(_SHORT)}) AS families_short,
                     corpus_id LIKE '%7' AS smoke FROM {{final_corpus}} GROUP BY corpus_id) a""".replace("SELECT *,", "SELECT * EXCLUDE (smoke),", 1),
    EXTRA,
)
def corpus_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_acceptance(final_corpus(spark, sf_dir), GATE_FAMILIES, 1, F.col("corpus_id").endswith("7"))


@query(
    "primary_partitions",
    "P-05 J-17",
    """SELECT designation AS partition, count(*) AS windows, count(DISTINCT run_id) AS runs,
              CAST(sum(CASE WHEN designation = 'benign' THEN samples END) AS BIGINT) AS benign_samples
       FROM {window_index} WHERE window_seconds = 30 AND designation IN ('benign', 'adversarial') GROUP BY designation""",
    EXTRA,
)
def primary_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "window_index")
    second = rows.where("designation = 'adversarial'").drop("samples")
    found = C.primary_rows(rows.where("designation <> 'adversarial'"), second)
    # A run counts once; its windows are grouped before runs are counted.
    per_run = found.groupBy("partition", "run_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("samples").alias("samples"))
    return per_run.groupBy("partition").agg(
        F.sum("windows").alias("windows"), F.count(F.lit(1)).alias("runs"), F.sum("samples").alias("benign_samples")
    )


# --- readings of every telemetry field ----------------------------------------------
# A reading from value v and unit u of a field; f picks one of nine faults or none.
READING = {
    "unit": "CASE f WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN 'GHz' ELSE u END",
    "supported": "CASE WHEN f IN (4, 5, 6) THEN true WHEN f IN (7, 8, 9) THEN false ELSE v IS NOT NULL END",
    "error": "CASE WHEN f IN (4, 7) THEN 'lost' WHEN f = 9 THEN '' WHEN f IN (5, 6, 8) THEN NULL WHEN v IS NULL THEN 'lost' END",
    "value": """CASE WHEN f IN (4, 7) THEN coalesce(v, CAST(1 AS DOUBLE)) WHEN f IN (5, 8, 9) THEN NULL WHEN f = 6 THEN CAST('Infinity' AS DOUBLE)
                ELSE v END""",
}
EXTRA["readings"] = " UNION ALL ".join(
    f"SELECT run_id, gpu_index, '{name}' AS name, {name} AS v, '{unit}' AS u, (sequence + {7 * i}) % 43 AS f FROM {{telemetry}}"
    for i, (name, unit) in enumerate(FIELD_UNITS.items())
)
_READING = {
    "missing_unit": "coalesce(unit, '') = ''",
    "unexpected_unit": "unit IS DISTINCT FROM u",
    "supported_with_error": "supported AND error IS NOT NULL",
    "supported_without_value": "supported AND value IS NULL",
    "not_finite": "supported AND NOT isfinite(value)",
    "unsupported_with_value": "NOT supported AND value IS NOT NULL",
    "unsupported_without_reason": "NOT supported AND coalesce(error, '') = ''",
}


@query(
    "reading_rule_counts",
    "S-03 S-04 P-03",
    f"""SELECT run_id, name, count(*) AS readings, {", ".join(f"count(*) FILTER (WHERE {rule}) AS {n}" for n, rule in _READING.items())}
        FROM (SELECT *, {", ".join(f"{text} AS {n}" for n, text in READING.items())} FROM {{readings}}) r GROUP BY run_id, name""",
    EXTRA,
)
def reading_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules per run and field, over all ten fields of one scan."""
    telemetry = view(spark, sf_dir, "telemetry")
    fields = [
        F.struct(F.lit(n).alias("name"), F.col(n).alias("v"), F.lit(u).alias("u"), ((F.col("sequence") + 7 * i) % 43).alias("f"))
        for i, (n, u) in enumerate(FIELD_UNITS.items())
    ]
    rows = telemetry.select("run_id", F.inline(F.array(*fields)))
    readings = rows.select("run_id", "name", *[F.expr(text).alias(n) for n, text in READING.items()])
    rules = R.reading_rules(*(F.col(n) for n in ("value", "unit", "supported", "error", "name")))
    return readings.groupBy("run_id", "name").agg(
        F.count(F.lit(1)).alias("readings"), *[F.count_if(rule).alias(n) for n, rule in rules.items()]
    )
