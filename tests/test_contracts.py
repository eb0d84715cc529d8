"""Contracts: a failing row for every rule, nulls, hot keys of ids, empty tables."""

import json

import pytest
from gaugeworks.plans import contracts as C
from gaugeworks.plans.matrix import STRATEGY_BOUNDS
from gaugeworks.schemas import COVERAGE_REASONS

PARAMETERS = tuple(row[1] for row in STRATEGY_BOUNDS)
NUMBERS = (*PARAMETERS, "batch_size", "sequence_length", "hidden_size", "layers", "heads", "matrix_size", "warmup_seconds", "min_measured_seconds", "estimated_seconds")
CONFIG = "entry_id long, workload_name string, config_id string, mode string, label string, family string, designation string, strategy_id string, "
CONFIG += "enabled_by_default boolean, requires_human_approval boolean, precision string, " + ", ".join(f"{n} double" for n in NUMBERS)


def config(strategy="idle_padding", **changes):
    """A sound adversarial configuration, or a benign one without a strategy."""
    row = {"mode": "ddp_train", "label": "training", "designation": "benign" if strategy is None else "adversarial", "strategy_id": strategy}
    row |= {"family": strategy or "ddp_training", "enabled_by_default": False, "requires_human_approval": True, "precision": None}
    row |= {"min_measured_seconds": 40.0, "estimated_seconds": 60.0, "warmup_seconds": 5.0}
    for owner, name, low, _high, _whole in STRATEGY_BOUNDS:
        if owner == strategy:
            row[name] = max(low, 10.0) if name == "segment_seconds" else low
    if strategy == "segmented_runs":
        row["min_measured_seconds"] = 10.0
    if strategy == "synthetic_communication_decoy":
        row |= {"mode": strategy, "label": "control"}
    if strategy in ("periodic_local_sgd", "diloco_inspired", "randomized_synchronization"):
        row["mode"] = "sparse_sync_training"
    return row | changes


def table(spark, rows):
    names = [f.split()[0] for f in CONFIG.split(", ")]
    full = [{"entry_id": i, "workload_name": f"w{i}", "config_id": f"c{i}"} | row for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], CONFIG)


STRATEGY_CASES = [
    *[(config(s[0]), "") for s in C.STRATEGY_CONTRACTS],
    (config(strategy_id="x"), "unknown_strategy"),
    (config(strategy_id=None), "unknown_strategy"),
    (config(family=None), "family_mismatch"),
    (config(label="control"), "label_mismatch"),
    (config(mode=None), "mode_mismatch"),
    (config(designation="benign"), "designation_not_adversarial"),
    (config(enabled_by_default=None), "enabled_by_default"),
    (config(requires_human_approval=False), "approval_not_required"),
    *[(config(s, **{n: None}), f"{n}_missing") for s, n, *_ in STRATEGY_BOUNDS if n != "segment_seconds"],
    *[(config(s, **{n: high * 2}), f"{n}_out_of_bounds") for s, n, _l, high, _w in STRATEGY_BOUNDS if n != "segment_seconds"],
    *[(config(s, **{n: high - 0.5}), f"{n}_not_integral") for s, n, _l, high, whole in STRATEGY_BOUNDS if whole and n != "segment_seconds"],
    *[(config(**{n: high + 1}), f"{n}_out_of_bounds") for n, _l, high, _w in C.COMMON_BOUNDS],
    *[(config(**{n: high - 0.5}), f"{n}_not_integral") for n, _l, high, whole in C.COMMON_BOUNDS if whole],
    (config(idle_padding_s=float("nan")), "idle_padding_s_out_of_bounds"),
    (config(hidden_size=100.0, heads=3.0), "hidden_size_not_divisible_by_heads"),
    (config(hidden_size=100.0, heads=0.0), "heads_out_of_bounds"),
    (config(precision="int8"), "precision_unknown"),
    (config("segmented_runs", segment_seconds=11.0), "duration_is_not_the_segment"),
    (config("segmented_runs", segment_seconds=None), "segment_seconds_missing"),
    (config(min_measured_seconds=34.0), "duration_out_of_range"),
    (config(min_measured_seconds=None), "duration_out_of_range"),
    (config(min_measured_seconds=61.0, label=None), "label_mismatch,duration_out_of_range"),
]


def test_every_strategy_rule(spark):
    found = {r["entry_id"]: ",".join(r["problems"]) for r in C.judge_strategies(table(spark, [c for c, _ in STRATEGY_CASES])).collect()}
    assert [found[i] for i in range(len(STRATEGY_CASES))] == [wanted for _, wanted in STRATEGY_CASES]


def test_strategies_without_parameter_columns(spark):
    frame = table(spark, [config("gradient_accumulation"), config(None)]).drop(*PARAMETERS, "heads", "precision")
    assert [(r[0], r[1]) for r in C.judge_strategies(frame).collect()] == [(0, ["gradient_accumulation_missing"])]


REGISTRY_CASES = [
    (config(None), ""),
    *[(config(None, **{n: value}), f"missing_{n}") for n in ("mode", "label", "family") for value in (None, "")],
    (config(None, config_id=""), "missing_config_id"),
    (config(None, config_id=None), "missing_config_id"),
    (config(None, designation=None), "missing_designation"),
    (config(None, config_id="same"), "shared_config_id"),
    (config(None, config_id="same", warmup_seconds=None), "shared_config_id,negative_warmup"),
    (config(None, min_measured_seconds=None), "measured_too_short"),
    (config(None, estimated_seconds=44.0), "estimate_too_short"),
    *[(config(None, **{n: most + 1.0}), f"{n}_above_limit") for n, most in C.BENIGN_LIMITS],
    *[(config(None, **{n: most + 0.5}), "") for n, most in C.BENIGN_LIMITS],
    (config(None, designation="calibration", min_measured_seconds=None, batch_size=99.0), ""),
    (config("segmented_runs"), ""),
    (config(min_measured_seconds=34.0), "measured_too_short,duration_out_of_range"),
    (config(estimated_seconds=None), "estimate_too_short"),
]


def test_every_registry_rule(spark):
    frame = table(spark, [c for c, _ in REGISTRY_CASES])
    found = {r["entry_id"]: ",".join(r["problems"]) for r in C.judge_registry(frame).collect()}
    assert [found[i] for i in range(len(REGISTRY_CASES))] == [wanted for _, wanted in REGISTRY_CASES]
    assert C.judge_registry(frame.limit(0)).isEmpty()


def test_gaps_of_registry_and_profiles(spark):
    rows = [config(None, family=f) for f in C.BENIGN_FAMILIES[1:]] + [config(s[0]) for s in C.STRATEGY_CONTRACTS]
    frame = table(spark, rows)
    strategies = [(f"w{7 + i}", True) for i in range(8)]
    members = [("whole", *m) for m in strategies] + [("short", *m) for m in strategies[1:]] + [("mixed", *m) for m in strategies]
    members += [("mixed", "w0", True), ("plain", "w0", False), ("plain", "gone", False), ("plain", "gone", False)]
    profiles = spark.createDataFrame(members, "profile string, workload_name string, adversarial boolean")
    found = {tuple(r) for r in C.registry_gaps(frame, profiles).collect()}
    assert found == {
        ("registry", "ddp_training", "missing_family"),
        ("short", "gradient_accumulation", "missing_strategy"),
        ("mixed", "inference_prefill_independent", "foreign_family"),
        ("plain", "gone", "unknown_workload"),
    }
    assert C.registry_gaps(frame.limit(0), profiles.limit(0)).count() == len(C.BENIGN_FAMILIES)


REFERENCE = dict.fromkeys(C.REFERENCE_FIELDS, "x") | {
    "calibration_artifact_path": "a/b.json",
    "calibration_sha256": "0f" * 32,
    "calibration_relationship": "prior_session",
    "calibration_created_in_current_session": False,
}
HEADER = {"schema_version": "2.0", "artifact_kind": "corpus_manifest", "collection_id": "c", "experiment_session_id": "s", "node_id": "n", "source_commit": "g"}
HEADER |= {"source_dirty": False, "random_seed": 1, "input_archive_sha256": None, "calibration_reference": json.dumps(REFERENCE)}
HEADER_CASES = [
    ({}, ""),
    ({"calibration_reference": None}, ""),
    ({"schema_version": None}, "unsupported_version"),
    *[({n: value}, f"missing_{n}") for n in C.CORPUS_FIELDS[1:] for value in (None, "")],
    ({"artifact_kind": "x"}, "wrong_kind"),
    ({"source_dirty": None}, "source_dirty_unknown"),
    ({"random_seed": -1}, "negative_seed"),
    ({"random_seed": None}, "negative_seed"),
    ({"input_archive_sha256": "0F" * 32}, "archive_digest_malformed"),
    ({"calibration_reference": "{"}, "reference_incomplete"),
    ({"calibration_reference": json.dumps({k: v for k, v in REFERENCE.items() if k != "calibration_status"})}, "reference_incomplete"),
    *[({"calibration_reference": json.dumps(REFERENCE | {"calibration_artifact_path": p})}, "reference_path_invalid") for p in ("", "/a", "a/../b", "..")],
    ({"calibration_reference": json.dumps(REFERENCE | {"calibration_sha256": "0f"})}, "reference_digest_malformed"),
    ({"calibration_reference": json.dumps(REFERENCE | {"calibration_relationship": "x"})}, "reference_relationship_unknown"),
    ({"calibration_reference": json.dumps(REFERENCE | {"calibration_created_in_current_session": True})}, "reference_labels_conflict"),
]
PLANS = "corpus_id string, plan_id string, accepted_run_id string, workload_family string, target_label string, designation string, config string, random_seed long, workload_config_id string"


def plan(corpus, name, run=None, family="f", label="l", designation="benign", config="{}", seed=0, config_id=None):
    return (corpus, name, run, family, label, designation, config, seed, config_id)


def test_every_corpus_rule(spark):
    kinds = "schema_version string, artifact_kind string, collection_id string, experiment_session_id string, node_id string, source_commit string, "
    kinds += "source_dirty boolean, random_seed long, input_archive_sha256 string, calibration_reference string"
    cases = [(f"h{i}", HEADER | changes, wanted) for i, (changes, wanted) in enumerate(HEADER_CASES)]
    sets = {
        "empty": ([], [], "no_planned_runs"),
        "unsound": ([plan("unsound", "p", family="")], [], "unsound_planned_run"),
        "repeated": ([plan("repeated", "p"), plan("repeated", "p")], [], "plan_repeated"),
        "twice": ([plan("twice", "p", "r"), plan("twice", "q", "r")], ["r"], "run_assigned_twice"),
        "listed": ([plan("listed", "p", "r")], ["r", "r"], "run_listed_twice"),
        "unlisted": ([plan("unlisted", "p", "r")], [], "run_assigned_not_listed"),
        "unassigned": ([plan("unassigned", "p")], ["r"], "run_listed_not_assigned"),
        "hot": ([plan("hot", f"p{i}", f"r{i}") for i in range(3000)], [f"r{i}" for i in range(3000)], ""),
    }
    cases += [(name, HEADER, wanted) for name, (_, _, wanted) in sets.items()]
    corpora = spark.createDataFrame([(n, *h.values()) for n, h, _ in cases], "corpus_id string, " + kinds)
    plans = [plan(n, "p") for n, _, _ in cases if n not in sets] + [p for ps, _, _ in sets.values() for p in ps]
    accepted = [(n, r) for n, (_, runs, _) in sets.items() for r in runs]
    frames = corpora, spark.createDataFrame(plans, PLANS), spark.createDataFrame(accepted, "corpus_id string, run_id string")
    found = {r[0]: ",".join(r[1]) for r in C.judge_corpora(*frames).collect()}
    assert found == {n: wanted for n, _, wanted in cases}
    assert C.judge_corpora(*(f.limit(0) for f in frames)).isEmpty()


def test_every_planned_run_rule(spark):
    cases = {
        plan("c", "p"): "",
        plan("c", None): "missing_plan_id",
        plan("c", "p", family=None): "missing_workload_family",
        plan("c", "p", label=""): "missing_target_label",
        plan("c", "p", designation=None): "unknown_designation",
        plan("c", "p", designation="x"): "unknown_designation",
        plan("c", "p", config="[1]"): "config_is_no_object",
        plan("c", "p", config="{"): "config_is_no_object",
        plan("c", "p", config=None): "config_is_no_object",
        plan("c", "p", seed=-1): "negative_seed",
        plan("c", "p", seed=None, config_id=""): "negative_seed,empty_config_id",
    }
    frame = spark.createDataFrame(list(cases), PLANS)
    found = {tuple(r)[:-1]: ",".join(r["problems"]) for r in frame.withColumn("problems", C.planned_run_problems()).collect()}
    assert found == cases


RECORD = {
    "plan_id": "p", "workload_family": "f", "target_label": "l", "experiment_session_id": "s", "collection_id": "c", "corpus_id": "main", "node_id": "n",
    "status": "included", "reason_code": None, "requested_windows": [5.0, 30.0], "common_overlap_seconds": 40.0, "usable_duration_seconds": 40.0,
    "configured_warmup_seconds": 0.0, "alignment_tolerance_seconds": 0.0, "rows_per_gpu": {"1": 0, "0": 3}, "emitted_windows": {"30": 0, "5": 1},
    "sampling_gaps": {"0": {"min": None}, "1": {}}, "aligned_sample_pairs": 0, "common_start_ns": 1, "common_end_ns": 1,
}
RECORD_TYPES = "plan_id string, workload_family string, target_label string, experiment_session_id string, collection_id string, corpus_id string, node_id string, "
RECORD_TYPES += "status string, reason_code string, requested_windows array<double>, common_overlap_seconds double, usable_duration_seconds double, "
RECORD_TYPES += "configured_warmup_seconds double, alignment_tolerance_seconds double, rows_per_gpu map<string,bigint>, emitted_windows map<string,bigint>, "
RECORD_TYPES += "sampling_gaps map<string,map<string,double>>, aligned_sample_pairs bigint, common_start_ns bigint, common_end_ns bigint"
RECORD_CASES = [
    ({}, ""),
    ({"status": "excluded", "reason_code": "feature_error"}, ""),
    ({"usable_duration_seconds": 40.0 + 1e-10}, ""),
    ({"common_start_ns": None, "common_end_ns": None}, ""),
    *[({n: None}, f"missing_{n}") for n in ("workload_family", "target_label", "experiment_session_id", "collection_id", "node_id")],
    ({"corpus_id": ""}, "missing_corpus_id,another_corpus"),
    ({"corpus_id": "other"}, "another_corpus"),
    ({"status": None}, "unknown_status"),
    ({"reason_code": "feature_error"}, "included_with_reason"),
    ({"status": "excluded"}, "excluded_without_known_reason"),
    ({"status": "excluded", "reason_code": "x"}, "excluded_without_known_reason"),
    ({"requested_windows": [], "emitted_windows": {}}, "windows_not_positive,other_windows"),
    ({"requested_windows": [0.5, -1.0], "emitted_windows": {"0.5": 1, "-1": 1}}, "windows_not_positive,other_windows"),
    ({"requested_windows": None}, "windows_not_positive,emitted_not_as_requested,other_windows"),
    ({"common_overlap_seconds": -1.0, "usable_duration_seconds": -1.0}, "negative_duration"),
    ({"usable_duration_seconds": 41.0}, "usable_exceeds_overlap"),
    ({"configured_warmup_seconds": -1.0}, "negative_configuration"),
    ({"alignment_tolerance_seconds": -0.1}, "negative_configuration"),
    ({"rows_per_gpu": {"0": 1}}, "rows_not_of_both_devices"),
    ({"rows_per_gpu": None}, "rows_not_of_both_devices"),
    ({"rows_per_gpu": {"0": 1, "1": None}}, "rows_no_count"),
    ({"emitted_windows": {"5": 1}}, "emitted_not_as_requested"),
    ({"emitted_windows": {"5": 1, "30": -1}}, "emitted_no_count"),
    ({"sampling_gaps": {"0": {}}}, "gaps_not_of_both_devices"),
    ({"sampling_gaps": {"0": {}, "1": {"max": -0.1}}}, "negative_gap"),
    ({"aligned_sample_pairs": None}, "negative_pairs"),
    ({"common_end_ns": None}, "one_end_of_the_interval"),
    ({"common_end_ns": 0}, "interval_reversed"),
    ({"plan_id": "same"}, "duplicate_plan"),
    ({"plan_id": "same", "node_id": ""}, "missing_node_id,duplicate_plan"),
    ({"plan_id": None}, "missing_plan_id"),
]


def test_every_coverage_record_rule(spark):
    rows = [RECORD | {"plan_id": f"p{i}"} | changes for i, (changes, _) in enumerate(RECORD_CASES)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], RECORD_TYPES)
    found = C.coverage_record_problems(frame, "main", (5, 30), COVERAGE_REASONS)
    wanted = sorted((str(r["plan_id"]), w) for r, (_, w) in zip(rows, RECORD_CASES, strict=True))
    assert sorted((str(r[0]), ",".join(r[1])) for r in found.collect()) == wanted
    with pytest.raises(ValueError, match="positive"):
        C.coverage_record_problems(frame, "main", (), COVERAGE_REASONS)


def test_primary_rows(spark):
    kinds = "run_id string, designation string, window_seconds double, a int"
    one = spark.createDataFrame([("b", "benign", 30.0, 1), ("c", "calibration", 30.0, 1), ("d", "benign", 5.0, 1), ("e", None, 30.0, 1), ("f", "benign", None, 1)], kinds)
    two = spark.createDataFrame([("x", "adversarial", 30.0, 2)], kinds.replace("a int", "z int"))
    found = {(r["run_id"], r["partition"], r["a"], r["z"]) for r in C.primary_rows(one, two).collect()}
    assert found == {("b", "benign", 1, None), ("x", "adversarial", None, 2)}
    for selected in (("benign",), ("adversarial", "benign"), ("adversarial", "adversarial"), (), ("x",)):
        with pytest.raises(ValueError):
            C.primary_rows(one, two, selected)


def test_completion_and_acceptance(spark):
    plans = [("k", "p1", "f", None, '{"repetition":3}'), ("k", "p2", "g", "cfg", "{"), ("k", "p3", "g", "cfg", None), ("k", "p4", "f", "cfg", '{"repetition":"x"}'), ("m", "p5", "f", None, "{}")]
    plans = spark.createDataFrame(plans, "corpus_id string, plan_id string, workload_family string, workload_config_id string, config string")
    good, bad = ("completed", True, 30.0), ("completed", True, None)
    tries = [("p1", "r1", *good), ("p1", "r0", *bad), ("p2", "r2", "failed", True, 40.0), ("p4", "r4", *good), ("p4", "r5", *good), ("p5", "r6", "completed", None, 40.0)]
    tries = spark.createDataFrame(tries, "plan_id string, run_id string, exit_status string, participation_valid boolean, measured_duration_seconds double")
    matrix = C.completion_matrix(plans, tries)
    found = {r["plan_id"]: (r["configuration_id"], r["repetition"], r["state"], r["accepted_run_id"], r["completed"]) for r in matrix.collect()}
    assert found == {
        "p1": (None, 3, "completed", "r1", True),
        "p2": ("cfg", None, "failed", None, False),
        "p3": ("cfg", None, "not_started", None, False),
        "p4": ("cfg", None, "ambiguous", None, False),
        "p5": (None, None, "failed", None, False),
    }
    for families, passed in ((("f",), {"k": True, "m": False}), (("f", "g"), {"k": False, "m": False})):
        rows = C.corpus_acceptance(matrix, families, 1).collect()
        assert {r["corpus_id"]: r["accepted"] for r in rows} == passed
    smoke = C.corpus_acceptance(matrix, ("f",), 1, matrix["corpus_id"] == "k").where("corpus_id = 'k'").first()
    assert (smoke["gate_passed"], smoke["accepted"], smoke["scientific_acceptance_state"]) == (True, False, "not_accepted")
    assert (smoke["planned"], smoke["launch_completed_count"], smoke["launch_failed_count"]) == (4, 1, 1)
    with pytest.raises(ValueError):
        C.corpus_acceptance(matrix, (), 1)


def test_coverage_records_of_one_plan_meet_as_verdicts(spark):
    names = "plan_id workload_family target_label experiment_session_id collection_id corpus_id node_id status reason_code".split()
    doubles = "common_overlap_seconds usable_duration_seconds configured_warmup_seconds alignment_tolerance_seconds".split()
    schema = ", ".join(f"{n} string" for n in names) + ", " + ", ".join(f"{n} double" for n in doubles)
    schema += ", requested_windows array<double>, rows_per_gpu map<string,bigint>, emitted_windows map<string,bigint>"
    schema += ", sampling_gaps map<string,map<string,double>>, aligned_sample_pairs long, common_start_ns long, common_end_ns long"
    frame = spark.createDataFrame([], schema)
    plan = C.coverage_record_problems(frame, "main", (5.0,), ())._jdf.queryExecution().optimizedPlan()
    join = next(line for line in plan.toString().splitlines() if "Join" in line)
    left = plan.toString().split(join)[1].split("Join")[0]
    assert "alone" in left and left.index("alone") < left.index("LocalRelation" if "LocalRelation" in left else "LogicalRDD")
