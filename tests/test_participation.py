"""The participation audit: a failing run for every check, and logs in any order."""

import random

import pytest
from gaugeworks.operators import evidence as E

EVENTS = (
    "run_id long, rank int, event string, mono_ns long, startup_rank int, local_rank int, gpu_index int, gpu_uuid string, "
    "world_size int, backend string, interval_start_ns long, interval_end_ns long, measured_duration_seconds double"
)
IDENTITY = {"startup_rank": None, "local_rank": None, "gpu_index": None, "gpu_uuid": None, "world_size": 2, "backend": "nccl"}
INTERVAL = {"interval_start_ns": 5, "interval_end_ns": 3_000_000_005, "measured_duration_seconds": 3.0}


def log(mode="smoke", designation="benign"):
    """A sound log of both ranks: (rank, event) to its details."""
    names = [*E.BASE_EVENTS, *E.MODE_EVENTS.get(mode, ("measurement_interval",))]
    names += ["strategy_summary"] if designation == "adversarial" else []
    found = {}
    for rank in (0, 1):
        for name in names:
            found[rank, name] = {}
        found[rank, "startup"] = {**IDENTITY, "startup_rank": rank, "local_rank": 1 - rank, "gpu_index": rank, "gpu_uuid": f"u{rank}"}
        if "measurement_interval" in names:
            found[rank, "measurement_interval"] = dict(INTERVAL)
    return found


def without(*gone, **kind):
    return {k: v for k, v in log(**kind).items() if k not in gone}


def changed(rank, event, mode="calibration", **details):
    found = log(mode)
    found[rank, event] = {**found[rank, event], **details}
    return found


CASES = {
    **{f"sound {mode}": (mode, "benign", log(mode), "") for mode in (*E.MODE_EVENTS, "inference")},
    "sound adversarial": ("sparse_sync_training", "adversarial", log("sparse_sync_training", "adversarial"), ""),
    "no summary": ("sparse_sync_training", "adversarial", log("sparse_sync_training"), "rank_0_missing:strategy_summary,rank_1_missing:strategy_summary"),
    "no interval": ("inference", "benign", without((1, "measurement_interval"), mode="inference"), "rank_1_missing:measurement_interval"),
    "two missing": ("smoke", "benign", without((0, "heartbeat"), (0, "completion")), "rank_0_missing:completion+heartbeat"),
    "no identity": ("smoke", "benign", without((1, "startup")), "rank_1_missing:startup,rank_1_without_identity"),
    "one rank": ("smoke", "benign", {k: v for k, v in log().items() if k[0] == 0}, "rank_1_missing:completion+cuda_operation_complete+heartbeat+startup,rank_1_without_identity"),
    "no log": ("smoke", "benign", {}, "rank_0_missing:completion+cuda_operation_complete+heartbeat+startup,rank_0_without_identity,"
               "rank_1_missing:completion+cuda_operation_complete+heartbeat+startup,rank_1_without_identity"),
    "backwards": ("calibration", "benign", changed(0, "measurement_interval", interval_end_ns=4), "rank_0_invalid_interval"),
    "no start": ("calibration", "benign", changed(1, "measurement_interval", interval_start_ns=None), "rank_1_invalid_interval"),
    "no duration": ("calibration", "benign", changed(1, "measurement_interval", measured_duration_seconds=None), "rank_1_invalid_interval"),
    "negative": ("calibration", "benign", changed(0, "measurement_interval", interval_end_ns=5, measured_duration_seconds=-1e-7), "rank_0_invalid_interval"),
    "off": ("calibration", "benign", changed(0, "measurement_interval", measured_duration_seconds=3.00001), "rank_0_invalid_interval"),
    "close": ("calibration", "benign", changed(0, "measurement_interval", measured_duration_seconds=3.0000005), ""),
    "same rank": ("calibration", "benign", changed(1, "startup", startup_rank=0), "ranks_not_zero_and_one"),
    "rank unknown": ("calibration", "benign", changed(1, "startup", startup_rank=None), "ranks_not_zero_and_one"),
    "local rank 2": ("calibration", "benign", changed(0, "startup", local_rank=2), "local_ranks_not_zero_and_one"),
    "same device": ("calibration", "benign", changed(0, "startup", gpu_index=1), "devices_not_zero_and_one"),
    "same uuid": ("calibration", "benign", changed(0, "startup", gpu_uuid="u1"), "device_uuids_not_distinct"),
    "one uuid": ("calibration", "benign", changed(0, "startup", gpu_uuid=None), ""),
    "world of 4": ("calibration", "benign", changed(1, "startup", world_size=4), "world_size_not_two"),
    "gloo": ("calibration", "benign", changed(0, "startup", backend="gloo"), "backend_not_nccl"),
    "no backend": ("calibration", "benign", changed(0, "startup", backend=None), "backend_not_nccl"),
    "failure": ("smoke", "benign", {**log(), (1, "failure"): {}}, ""),
}


@pytest.fixture(scope="module")
def audit(spark):
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    runs, events = [], []
    for run, (mode, designation, entries, _) in enumerate(CASES.values()):
        runs.append((run, mode, designation))
        for (rank, event), details in entries.items():
            events.append(tuple({"run_id": run, "rank": rank, "event": event, "mono_ns": 100, **details}.get(c) for c in columns))
            # Later entries of the same name do not count, nor do unknown names and other ranks.
            if event in ("startup", "measurement_interval"):
                events.append((run, rank, event, 101) + (None,) * 9)
        events += [(run, 0, f"step {i}", 50, *(None,) * 9) for i in range(3)] + [(run, 2, "startup", 1, *(None,) * 9)] * bool(entries)
    random.Random(3).shuffle(events)
    found = E.participation_audit(spark.createDataFrame(runs, "run_id long, mode string, designation string"), spark.createDataFrame(events, EVENTS))
    return {r.run_id: r for r in found.collect()}


@pytest.mark.parametrize("name", CASES)
def test_problems(audit, name):
    row = audit[list(CASES).index(name)]
    assert ",".join(row.problems) == CASES[name][3]
    assert row.participation_valid == (not CASES[name][3])
    entries = CASES[name][2]
    for rank in (0, 1):
        failed = (rank, "failure") in entries or (rank, "completion") not in entries
        assert row[f"rank_{rank}_exit"] == failed


def test_no_runs(spark):
    runs = spark.createDataFrame([], "run_id long, mode string, designation string")
    assert E.participation_audit(runs, spark.createDataFrame([], EVENTS)).count() == 0
