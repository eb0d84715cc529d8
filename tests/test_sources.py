"""JSON lines, linked extractions, CSV cells and checksums."""

import json
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugeworks.operators import rules as R
from gaugeworks.schemas import FIELD_UNITS
from gaugeworks.sources import evidence as E


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def record(**changes):
    body = {
        "artifact_kind": "telemetry_sample",
        "schema_version": "2.0",
        "run_id": "r",
        "gpu_index": 0,
        "gpu_uuid": "g",
        "sequence": 0,
        "wall_time_utc": "2024-01-01T00:00:00Z",
        "monotonic_ns": 1,
        "fields": {n: {"value": 0.0, "unit": u, "supported": True, "error": None} for n, u in FIELD_UNITS.items()},
        "target_sampling_interval_s": 1.0,
        "rank": 0,
        "process_id": 5,
        "raw_unit_metadata": {"pcie_nvml_raw_unit": "KB/second (NVML API)", "pcie_bytes_multiplier": "1024"},
    }
    body.update(changes)
    return body


def test_read_evidence_separates_broken_lines(spark, folder):
    for run in ("a", "b"):
        os.makedirs(f"{folder}/runs/{run}")
        with open(f"{folder}/runs/{run}/telemetry.jsonl", "w") as sink:
            sink.write(json.dumps(record(run_id=run)) + "\n\n{broken\n")
    good, bad = E.read_evidence(spark, f"{folder}/runs/*/telemetry.jsonl", "telemetry_sample")
    assert sorted(r["run_id"] for r in good.select("run_id").collect()) == ["a", "b"]
    assert {r["text"] for r in bad.collect()} == {"{broken"}


def test_sample_rules(spark, folder):
    missing = {n: v for n, v in record()["fields"].items() if n != "memory_total_bytes"}
    bad_value = {**record()["fields"], "power_draw_w": {"value": 1.0, "unit": "watts", "supported": False, "error": None}}
    rows = {
        "ok": record(),
        "version": record(schema_version="3"),
        "zone": record(wall_time_utc="2024-01-01T00:00:00"),
        "nine": record(fields=missing),
        "legacy_nine": record(fields=missing, schema_version="1.0"),
        "reading": record(fields=bad_value),
        "unit": record(raw_unit_metadata={}),
        "interval": record(target_sampling_interval_s=0.0),
    }
    with open(f"{folder}/t.jsonl", "w") as sink:
        for name, body in rows.items():
            sink.write(json.dumps({**body, "run_id": name}) + "\n")
    good, _ = E.read_evidence(spark, f"{folder}/t.jsonl", "telemetry_sample")
    found = {r["run_id"]: r["v"] for r in good.select("run_id", R.violations(R.sample_rules()).alias("v")).collect()}
    assert found == {
        "ok": [],
        "version": ["unsupported_version"],
        "zone": ["time_without_zone"],
        "nine": ["unexpected_fields"],
        "legacy_nine": [],
        "reading": ["invalid_reading"],
        "unit": ["raw_unit_not_preserved"],
        "interval": ["target_interval_not_positive"],
    }


def test_sinks_never_overwrite(spark, folder):
    frame = spark.createDataFrame([(2, [1, 2], "x")], "b int, a array<int>, c string")
    E.write_json_once(frame, f"{folder}/j")
    with pytest.raises(AnalysisException):
        E.write_json_once(frame, f"{folder}/j")
    E.write_csv_once(frame, f"{folder}/c")
    row = spark.read.option("header", True).csv(f"{folder}/c").first()
    assert row.asDict() == {"a": "[1,2]", "b": "2", "c": "x"}


def test_linked_extraction(spark, folder):
    frame = spark.range(3)
    for name in ("e-1", "e-2"):
        E.write_extraction(frame.withColumn("n", F.lit(name)), frame, frame.limit(1), folder, name)
    features, coverage, summary = E.load_extraction(spark, folder)
    assert {r["n"] for r in features.collect()} == {"e-2"} and coverage.count() == 3 and summary.count() == 1
    assert {r["n"] for r in E.load_extraction(spark, folder, "e-1")[0].collect()} == {"e-1"}
    with pytest.raises(ValueError):
        E.load_extraction(spark, folder, "../e-1")


def test_checksums(spark, folder):
    os.makedirs(f"{folder}/d")
    for name in ("x", "y"):
        with open(f"{folder}/d/{name}.bin", "w") as sink:
            sink.write(name)
    actual = E.checksums(spark, f"{folder}/d")
    expected = actual.select("path", F.when(F.col("path").endswith("x.bin"), "0").otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.createDataFrame([("file:/nowhere", "1")], "path string, sha256 string")
    problems = {r["path"].split("/")[-1]: r["problem"] for r in E.verify_checksums(actual, expected.union(gone)).collect()}
    assert problems == {"x.bin": "changed", "nowhere": "missing"}


def test_split_sink(spark, folder):
    frame = spark.createDataFrame([(1, "train"), (2, "test")], "run_id bigint, split string")
    E.write_splits(frame, "s", f"{folder}/splits")
    assert spark.read.parquet(f"{folder}/splits").where("split = 'test'").first()["run_id"] == 2


def test_a_view_name_is_given_once():
    import __spark_entry__  # noqa: F401  (loads every module that adds views)
    from gaugeworks.sources.views import BASE_TABLES, VIEWS

    assert "key-of-" in VIEWS["registry"] and "entry_id" in VIEWS["workload_registry"]
    for name in ("registry", BASE_TABLES[0]):
        with pytest.raises(ValueError):
            VIEWS[name] = "SELECT 1"
