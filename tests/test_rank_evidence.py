"""Rank evidence: one failing run for every rule, types as JSON has them."""

import json

import pytest
from gaugeworks.operators import rules as R

SUMMARY = {
    "actual_sync_rounds": 4, "expected_sync_rounds": 4, "communication_bytes_proxy": 10, "optimizer_steps": 3, "inference_steps": 0,
    "processed_tokens": 99, "throughput_tokens_per_s": 1.5, "final_loss_proxy": None, "wall_time_s": 30, "strategy_id": "s",
    "communication_proxy_definition": "bytes", "detector_score": None, "detector_score_status": R.UNSCORED, "parameter_state_agreement": True,
}
MEMORY = {"allocated_bytes": 1, "reserved_bytes": 2}


def config(rank=0, memory=MEMORY, drop=None, **changes):
    ranks = {str(r): {"strategy_summary": dict(SUMMARY), "memory_peak": dict(MEMORY)} for r in (0, 1)}
    ranks[str(rank)]["memory_peak"] = memory
    ranks[str(rank)]["strategy_summary"].update(changes)
    ranks[str(rank)]["strategy_summary"].pop(drop, None)
    return {"strategy_id": "s", "rank_runtime_evidence": ranks}


def evidence(**ranks):
    return {"strategy_id": "s", "rank_runtime_evidence": {k[1:]: v for k, v in ranks.items()}}


SOUND = {"strategy_summary": SUMMARY, "memory_peak": MEMORY}
GONE = "ranks_not_zero_and_one,rank_0_summary_missing,rank_1_summary_missing"
CASES = {
    "sound": (config(), ""),
    "no config": (None, GONE),
    "no object": ("[1]", GONE),
    "no JSON": ("{", GONE),
    "one rank": (evidence(r0=SOUND), "ranks_not_zero_and_one,rank_1_summary_missing"),
    "three ranks": (evidence(r0=SOUND, r1=SOUND, r2={}), "ranks_not_zero_and_one"),
    "summary is text": (evidence(r0=SOUND, r1={"strategy_summary": "x", "memory_peak": MEMORY}), "rank_1_summary_missing"),
    "rounds differ": (config(1, expected_sync_rounds=5), "rank_1_sync_counts_differ"),
    "ranks disagree": (config(1, expected_sync_rounds=5, actual_sync_rounds=5), "ranks_disagree_on_rounds"),
    "rounds negative": (config(actual_sync_rounds=-1), "rank_0_sync_counts_invalid"),
    "rounds a fraction": (config(expected_sync_rounds=4.5), "rank_0_sync_counts_invalid"),
    "rounds text": (config(expected_sync_rounds="4"), "rank_0_sync_counts_invalid"),
    **{f"no {n}": (config(1, drop=n), f"rank_1_{n}_invalid") for n in (*R.EVIDENCE_COUNTS, "wall_time_s")},
    **{f"negative {n}": (config(**{n: -2}), f"rank_0_{n}_invalid") for n in (*R.EVIDENCE_COUNTS, "throughput_tokens_per_s", "final_loss_proxy", "wall_time_s")},
    **{f"{n} is true": (config(**{n: True}), f"rank_0_{n}_invalid") for n in ("throughput_tokens_per_s", "final_loss_proxy", "wall_time_s")},
    "loss beyond numbers": (json.dumps(config(final_loss_proxy=777)).replace("777", "1e999"), "rank_0_final_loss_proxy_invalid"),
    "metrics absent": (config(drop="throughput_tokens_per_s"), ""),
    "score": (config(detector_score=0.5), "rank_0_scored_at_run_time"),
    "score negative": (config(detector_score=-1), "rank_0_detector_score_invalid,rank_0_scored_at_run_time"),
    "model": (config(1, detector_model="m"), "rank_1_scored_at_run_time"),
    "status": (config(detector_score_status="done"), "rank_0_scored_at_run_time"),
    "no status": (config(drop="detector_score_status"), "rank_0_detector_score_status_empty,rank_0_scored_at_run_time"),
    "no definition": (config(communication_proxy_definition=""), "rank_0_communication_proxy_definition_empty"),
    "other strategy": (config(strategy_id="t"), "rank_0_strategy_mismatch"),
    "no strategy": (config(strategy_id=None), "rank_0_strategy_id_empty,rank_0_strategy_mismatch"),
    "no memory": (config(memory=None), "rank_0_memory_peak_invalid"),
    "half memory": (config(memory={"allocated_bytes": 3}), "rank_0_memory_peak_invalid"),
    "negative memory": (config(1, memory={"allocated_bytes": 3, "reserved_bytes": -3}), "rank_1_memory_peak_invalid"),
    "disagreement": (config(parameter_state_agreement=False), "rank_0_parameters_disagree"),
    "agreement is text": (config(1, parameter_state_agreement="true"), "rank_1_parameters_disagree"),
}


@pytest.fixture(scope="module")
def audit(spark):
    columns = "run_id string, schema_version string, designation string, exit_status string, participation_valid boolean, workload_label string, config string"
    wanted = ("2.0", "adversarial", "completed", True)
    rows = [(n, *wanted, "training", c if c is None or isinstance(c, str) else json.dumps(c)) for n, (c, _) in CASES.items()]
    rows.append(("inference", *wanted, "inference", json.dumps(config(drop="parameter_state_agreement"))))
    for n, facts in enumerate((("1.0", *wanted[1:]), ("2.0", "benign", "completed", True), ("2.0", "adversarial", "failed", True), (*wanted[:3], False), (*wanted[:3], None))):
        rows.append((f"skipped {n}", *facts, "training", None))
    return {r.run_id: ",".join(r.problems) for r in R.rank_evidence_audit(spark.createDataFrame(rows, columns)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_problems(audit, name):
    assert audit[name] == CASES[name][1]


def test_which_runs(audit):
    assert set(audit) == {*CASES, "inference"}
    assert audit["inference"] == ""


def test_every_value_is_walked_and_typed_once(spark):
    schema = "run_id string, workload_label string, schema_version string, designation string, exit_status string, participation_valid boolean, config string"
    found = R.rank_evidence_audit(spark.createDataFrame([], schema).repartition(2))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant(") <= 2 * (len(R.SUMMARY_VALUES) + len(R.MEMORY_VALUES)) + 3
    assert plan.count("try_parse_json(") + plan.count("parse_json(") <= 2
