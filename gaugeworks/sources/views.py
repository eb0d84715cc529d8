"""Evidence tables derived from the star-schema tables, in SQL that Spark and DuckDB share.

``{table}`` marks a base table or another view. On Spark it is filled with a
DataFrame (``spark.sql(text, name=frame)``), for the check it becomes a CTE name.
Values are whole numbers held as doubles, so sums are exact in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


class _Views(dict[str, str]):
    """View texts by name; a name is given once, whichever module adds it."""

    def __setitem__(self, name: str, text: str) -> None:
        if name in self or name in BASE_TABLES:
            raise ValueError(f"duplicate view {name}")
        super().__setitem__(name, text)


VIEWS: dict[str, str] = _Views()

# One counter sample per line item: a ship day is a second, the keys add milliseconds.
VIEWS["telemetry"] = """
SELECT CAST(l_suppkey AS BIGINT) AS run_id,
       CAST(CASE WHEN l_suppkey % 61 = 17 THEN 0 ELSE l_linenumber % 2 END AS INT) AS gpu_index,
       ((CAST(year(l_shipdate) AS BIGINT) - 1995) * 372 + (month(l_shipdate) - 1) * 31
         + day(l_shipdate)) * 1000000000
         + ((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 1000) * 1000000 AS mono_ns,
       CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS sequence,
       CASE WHEN l_suppkey % 53 = 21 THEN '9.9' ELSE '2.0' END AS schema_version,
       CAST(round(l_discount * 1000) AS DOUBLE) AS gpu_utilization_pct,
       CAST(round(l_tax * 1000) AS DOUBLE) AS memory_utilization_pct,
       CAST(l_orderkey % 4096 AS DOUBLE) AS memory_used_bytes,
       CAST(16000 AS DOUBLE) AS memory_total_bytes,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL
            ELSE CAST(round(l_tax * 1000) + l_quantity AS DOUBLE) END AS power_draw_w,
       CAST(l_quantity + 30 AS DOUBLE) AS temperature_c,
       CAST(600 + (l_partkey % 10) * 100 AS DOUBLE) AS sm_clock_mhz,
       CAST(5000 AS DOUBLE) AS memory_clock_mhz,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL
            ELSE CAST(floor(l_extendedprice) AS DOUBLE) END AS pcie_tx_bytes_per_s,
       CASE WHEN l_partkey % 19 = 0 THEN NULL
            ELSE CAST(l_quantity * 1000 AS DOUBLE) END AS pcie_rx_bytes_per_s
FROM {lineitem}
"""

# One run manifest per supplier, with failures, invalid runs and measured intervals.
VIEWS["runs"] = """
SELECT CAST(s_suppkey AS BIGINT) AS run_id,
       concat('session-', CAST(CAST(floor(s_suppkey / CAST(8 AS DOUBLE)) AS BIGINT) % 3 AS STRING))
         AS experiment_session_id,
       CASE s_suppkey % 8 WHEN 0 THEN 'ddp_training' WHEN 1 THEN 'inference_prefill_independent'
            WHEN 2 THEN 'inference_decode_independent' WHEN 3 THEN 'inference_synchronized'
            WHEN 4 THEN 'control_compute' WHEN 5 THEN 'control_host_transfer'
            WHEN 6 THEN 'control_model_or_checkpoint_load' ELSE 'control_idle' END
         AS workload_family,
       CASE WHEN s_suppkey % 8 = 0 THEN 'training' WHEN s_suppkey % 8 <= 3 THEN 'inference'
            ELSE 'control' END AS target_label,
       concat('config-', CAST(s_suppkey % 16 AS STRING)) AS workload_config_id,
       CASE WHEN s_suppkey % 23 = 5 THEN 'calibration' WHEN s_suppkey % 23 = 7 THEN 'adversarial'
            ELSE 'benign' END AS designation,
       CASE WHEN s_suppkey % 29 = 3 THEN 'failed' ELSE 'completed' END AS exit_status,
       s_suppkey % 31 <> 4 AS participation_valid,
       CAST(s_suppkey % 5 AS DOUBLE) AS warmup_seconds,
       s_suppkey % 37 = 9 AS legacy_grouping_ambiguous,
       CASE WHEN s_suppkey % 7 = 3 THEN CAST(200000000000 AS BIGINT) END AS measurement_start_ns,
       CASE WHEN s_suppkey % 67 = 24 THEN CAST(230000000000 AS BIGINT)
            WHEN s_suppkey % 7 = 3 THEN CAST(2000000000000 AS BIGINT) END AS measurement_end_ns,
       CASE WHEN s_suppkey % 41 = 11 THEN 'corpus-other' ELSE 'corpus-main' END AS corpus_id,
       concat('node-', CAST(s_nationkey % 4 AS STRING)) AS node_id,
       s_acctbal AS wall_cost
FROM {supplier}
"""

# Declared corpus: one plan per supplier; some without an accepted run, some not matching it.
VIEWS["planned_runs"] = """
SELECT concat('plan-', CAST(s_suppkey AS STRING)) AS plan_id,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 47 = 13 THEN -CAST(s_suppkey AS BIGINT)
            ELSE CAST(s_suppkey AS BIGINT) END AS accepted_run_id,
       CASE WHEN s_suppkey % 43 = 12 THEN 'control_idle' ELSE
         CASE s_suppkey % 8 WHEN 0 THEN 'ddp_training' WHEN 1 THEN 'inference_prefill_independent'
            WHEN 2 THEN 'inference_decode_independent' WHEN 3 THEN 'inference_synchronized'
            WHEN 4 THEN 'control_compute' WHEN 5 THEN 'control_host_transfer'
            WHEN 6 THEN 'control_model_or_checkpoint_load' ELSE 'control_idle' END END
         AS workload_family,
       CASE WHEN s_suppkey % 8 = 0 THEN 'training' WHEN s_suppkey % 8 <= 3 THEN 'inference'
            ELSE 'control' END AS target_label,
       CASE WHEN s_suppkey % 23 = 5 THEN 'calibration' WHEN s_suppkey % 23 = 7 THEN 'adversarial'
            ELSE 'benign' END AS designation,
       CASE WHEN s_suppkey % 9 = 4 THEN NULL
            ELSE concat('config-', CAST(s_suppkey % 16 AS STRING)) END AS workload_config_id,
       concat('session-', CAST(CAST(floor(s_suppkey / CAST(8 AS DOUBLE)) AS BIGINT) % 3 AS STRING))
         AS experiment_session_id,
       'corpus-main' AS corpus_id
FROM {supplier}
"""

# Calibration observations: one per order, fifty sweeps.
VIEWS["observations"] = """
SELECT CAST(o_custkey % 50 AS BIGINT) AS sweep_id, CAST(o_orderkey AS BIGINT) AS run_id,
       CASE WHEN o_orderkey % 997 = 3 THEN 'unlabelled'
            WHEN o_orderkey % 6 = 0 THEN 'idle_baseline'
            WHEN o_orderkey % 5 = 2 THEN NULL ELSE 'collective' END AS observation_type,
       o_orderkey % 6 = 0 AS is_idle,
       CASE WHEN o_orderkey % 331 = 1 THEN CAST(-1 AS DOUBLE) ELSE
         CAST(CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 16
              WHEN 4 THEN 64 ELSE 128 END AS DOUBLE) END AS payload_mib,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL
            ELSE CAST(floor(o_totalprice) AS DOUBLE)
              * CAST(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 10 * (o_orderkey % 6) END AS DOUBLE)
         END AS pcie_total_mean_bytes_per_s,
       o_orderkey % 43 <> 0 AS pcie_supported,
       o_orderstatus <> 'P' AS participation_valid,
       CASE WHEN o_orderkey % 59 = 7 THEN 'failed' WHEN o_orderkey % 7 = 1 THEN NULL
            ELSE 'completed' END AS exit_status,
       CASE WHEN o_orderkey % 61 = 5 THEN NULL ELSE CAST(25 + o_orderkey % 20 AS DOUBLE) END
         AS measured_duration_seconds,
       CAST(1 AS DOUBLE) AS requested_interval_s,
       CASE WHEN o_orderkey % 67 = 8 THEN NULL
            ELSE CAST(100 + o_orderkey % 13 AS DOUBLE) / CAST(100 AS DOUBLE) END AS mean_interval_s,
       CAST(o_orderkey % 5 AS BIGINT) AS repetition
FROM {orders}
"""

# Detector scores: one per line item, many ties.
VIEWS["scores"] = """
SELECT CAST(l_suppkey AS BIGINT) AS run_id,
       CAST(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS y,
       CAST(round(l_discount * 500 + CASE WHEN l_suppkey % 2 = 0 THEN l_tax * 500 ELSE 0 END)
            AS DOUBLE) / CAST(100 AS DOUBLE) AS p,
       CASE l_suppkey % 8 WHEN 0 THEN 'ddp_training' WHEN 3 THEN 'synchronized_prefill'
            WHEN 5 THEN 'host_device_transfer' WHEN 7 THEN 'inference_synchronized'
            WHEN 1 THEN 'control_host_transfer' ELSE concat('family-', l_returnflag) END
         AS workload_family,
       concat('session-', l_linestatus) AS experiment_session_id,
       concat('config-', CAST(l_partkey % 5 AS STRING)) AS workload_config_id,
       CASE CAST(l_suppkey AS BIGINT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation'
            ELSE 'train' END AS split,
       CASE WHEN l_suppkey % 8 = 0 THEN 'training' WHEN l_suppkey % 8 <= 3 THEN 'inference'
            ELSE 'control' END AS target_label,
       CASE WHEN l_quantity <= 15 THEN 'training' WHEN l_quantity <= 33 THEN 'inference'
            ELSE 'control' END AS predicted_label,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS DOUBLE) END AS signal_a,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_quantity * 1000 AS DOUBLE) END AS signal_b
FROM {lineitem}
"""

# Identity rows of features: one per (run, minute), with conflicts and gaps in the metadata.
VIEWS["feature_index"] = """
SELECT t.run_id, t.window_index,
       CASE WHEN r.target_label = 'control' AND t.run_id % 73 = 6 THEN CAST(30 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END
         AS window_seconds,
       CASE WHEN t.run_id % 79 = 25 THEN NULL ELSE r.experiment_session_id END AS experiment_session_id,
       r.target_label, r.workload_family,
       CASE WHEN t.run_id % 71 = 19 AND t.window_index % 2 = 1 THEN 'config-other' ELSE r.workload_config_id END
         AS workload_config_id,
       r.legacy_grouping_ambiguous, r.designation, t.samples
FROM (SELECT run_id, CAST(floor(mono_ns / CAST(60000000000 AS DOUBLE)) AS BIGINT) AS window_index, count(*) AS samples
      FROM {telemetry} GROUP BY run_id, CAST(floor(mono_ns / CAST(60000000000 AS DOUBLE)) AS BIGINT)) t
JOIN {runs} r ON r.run_id = t.run_id
"""

# Monitoring messages before numbering: one per event, with one kind of fault per modulus.
VIEWS["message_events"] = """
SELECT event_id, concat('batch-', CAST(event_id AS STRING)) AS message_id,
       concat('agent-', CAST(user_id AS STRING)) AS agent_id,
       concat('node-', CAST(user_id % 4 AS STRING)) AS node_id, ts AS received_at, value,
       CASE WHEN event_type = 'error' THEN 'heartbeat' ELSE 'telemetry_batch' END AS message_type,
       CASE WHEN event_id % 139 = 5 THEN 'payload_too_large'
            WHEN event_id % 89 = 7 THEN 'unsupported_protocol_version'
            WHEN user_id % 29 = 7 THEN 'unknown_agent'
            WHEN event_id % 107 = 9 THEN 'node_identity_mismatch'
            WHEN event_id % 109 = 11 THEN 'invalid_signature'
            WHEN event_id % 113 = 13 THEN 'session_mismatch'
            WHEN event_id % 127 = 17 THEN 'unknown_message_type'
            WHEN event_id % 149 = 23 THEN 'invalid_message'
            WHEN event_id % 131 = 19 AND event_type <> 'error' THEN 'privacy_violation'
            WHEN event_id % 137 = 21 AND event_type <> 'error' THEN 'invalid_sample' END AS stateless_fault,
       CASE WHEN event_id % 97 = 1 THEN 'gap' WHEN event_id % 101 = 2 THEN 'stale'
            WHEN event_id % 83 = 3 THEN 'skew'
            WHEN event_id % 79 = 4 AND event_type <> 'error' THEN 'sample_skew'
            WHEN event_id % 103 = 6 AND event_type <> 'error' THEN 'chain' END AS stateful_fault
FROM {events}
"""
# Registered agents: every user of the stream but one in twenty-nine.
VIEWS["registry"] = """
SELECT DISTINCT concat('agent-', CAST(user_id AS STRING)) AS agent_id,
       concat('node-', CAST(user_id % 4 AS STRING)) AS node_id,
       concat('key-of-', CAST(user_id AS STRING)) AS secret
FROM {events} WHERE user_id % 29 <> 7
"""

# Run manifests, one per order; a customer is a plan and its orders are the attempts.
VIEWS["manifests"] = """
SELECT concat('run-', CAST(o_orderkey AS STRING)) AS run_id, concat('plan-', CAST(o_custkey AS STRING)) AS plan_id,
       concat('runs/', CAST(o_orderkey AS STRING), '/manifest.json') AS path,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'ddp_training' WHEN '2-HIGH' THEN 'periodic_local_sgd'
            WHEN '3-MEDIUM' THEN 'inference_synchronized' WHEN '4-NOT SPECIFIED' THEN 'idle_padding' ELSE 'control_idle' END AS workload_family,
       CASE WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED')
            THEN CASE WHEN o_orderkey % 1009 = 4 THEN 'benign' ELSE 'adversarial' END ELSE 'benign' END AS designation,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') THEN 'training'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'inference' ELSE 'control' END AS workload_label,
       CASE WHEN o_orderkey % 61 = 1 THEN 'timeout' WHEN o_orderkey % 37 = 2 THEN 'failed'
            WHEN o_orderkey % 503 = 3 THEN 'unknown' ELSE 'completed' END AS exit_status,
       CASE WHEN o_orderkey % 122 = 1 THEN NULL ELSE 'reason' END AS failure_reason,
       o_orderstatus <> 'P' AS participation_valid,
       CASE WHEN o_orderkey % 307 = 5 THEN 3 ELSE 2 END AS world_size,
       CASE WHEN o_orderkey % 311 = 6 THEN CAST(-1 AS DOUBLE) ELSE CAST(o_orderkey % 5 AS DOUBLE) END AS warmup_seconds,
       CASE WHEN o_orderkey % 401 = 7 THEN '9.9' WHEN o_orderkey % 13 = 8 THEN '1.0' ELSE '2.0' END AS schema_version,
       CASE WHEN o_orderkey % 409 = 9 THEN NULL ELSE concat('session-', CAST(o_custkey % 6 AS STRING)) END AS experiment_session_id,
       CASE WHEN o_orderkey % 13 = 8 THEN NULL ELSE 'corpus-main' END AS corpus_id,
       CASE WHEN o_orderkey % 419 = 10 THEN '' ELSE concat('env-', CAST(o_custkey % 9 AS STRING)) END AS environment_fingerprint,
       concat('commit-', CAST(o_custkey % 4 AS STRING)) AS source_commit,
       CASE WHEN o_orderkey % 421 = 11 THEN '2024-01-01T00:00:00' ELSE '2024-01-01T00:00:00Z' END AS started_at_utc,
       CAST(o_orderkey AS BIGINT) * 1000 AS seed,
       CAST(o_orderkey AS BIGINT) * 1000 + CASE WHEN o_orderkey % 431 = 12 THEN 1 ELSE 0 END AS random_seed,
       CASE WHEN o_orderkey % 433 = 13 THEN NULL ELSE CAST(o_orderkey AS BIGINT) * 1000000 END AS measurement_start_ns,
       CAST(o_orderkey AS BIGINT) * 1000000 + (25 + o_orderkey % 20) * 1000000000 AS measurement_end_ns,
       CAST(25 + o_orderkey % 20 AS DOUBLE) + CASE WHEN o_orderkey % 439 = 14 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
         AS measured_duration_seconds,
       CASE WHEN o_orderkey % 443 = 15 THEN 'h-other' ELSE concat('h-', CAST(o_custkey AS STRING)) END AS planned_hash,
       CAST(floor(o_totalprice) AS DOUBLE) / CAST(100 AS DOUBLE) AS wall_seconds,
       CAST(CASE o_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS BIGINT) AS local_steps,
       CAST(o_orderkey % 100 AS BIGINT) AS sync_rounds,
       concat('{"mode":"train","rank_runtime_evidence":{',
         '"0":{"strategy_summary":{"actual_sync_rounds":', CAST(o_orderkey % 100 AS STRING),
         ',"expected_sync_rounds":', CAST(o_orderkey % 100 + CASE WHEN o_orderkey % 449 = 16 THEN 1 ELSE 0 END AS STRING),
         ',"communication_bytes_proxy":', CAST(o_orderkey % 5000 AS STRING), ',"final_loss_proxy":',
         CASE WHEN o_orderkey % 457 = 17 THEN 'null' ELSE CAST(o_orderkey % 7 AS STRING) END, '},"memory_peak":{"allocated_bytes":',
         CAST(o_orderkey % 900 AS STRING), '}},',
         '"1":{"strategy_summary":{"actual_sync_rounds":', CAST(o_orderkey % 100 + CASE WHEN o_orderkey % 461 = 18 THEN 2 ELSE 0 END AS STRING),
         ',"expected_sync_rounds":', CAST(o_orderkey % 100 + CASE WHEN o_orderkey % 461 = 18 THEN 2 ELSE 0 END AS STRING),
         ',"communication_bytes_proxy":', CAST(o_orderkey % 4000 AS STRING), ',"final_loss_proxy":', CAST(o_orderkey % 11 AS STRING),
         CASE WHEN o_orderkey % 463 = 19 THEN ',"detector_score":1' ELSE '' END, '},"memory_peak":{"allocated_bytes":',
         CAST(o_orderkey % 800 AS STRING), '}}}}') AS config
FROM {orders}
"""
# Rank event log: one event per order, fifteen customers to a run.
VIEWS["rank_events"] = """
SELECT CAST(floor(o_custkey / CAST(15 AS DOUBLE)) AS BIGINT) AS run_id,
       CAST(floor(o_orderkey / CAST(9 AS DOUBLE)) AS BIGINT) % 2 AS rank,
       CASE o_orderkey % 9 WHEN 0 THEN 'collective_start' WHEN 1 THEN 'collective_complete' WHEN 2 THEN 'measurement_interval'
            WHEN 3 THEN 'startup' WHEN 4 THEN 'cuda_operation_complete' WHEN 5 THEN 'heartbeat' WHEN 6 THEN 'completion'
            WHEN 7 THEN 'memory_peak' ELSE 'model_ready' END AS event,
       ((CAST(year(o_orderdate) AS BIGINT) - 1995) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate)) * 1000000000 AS mono_ns,
       CAST(100 + o_orderkey % 50 AS BIGINT) * 1000000000 AS interval_start_ns,
       CAST(2000 - o_orderkey % 50 AS BIGINT) * 1000000000 AS interval_end_ns,
       concat('GPU-', CAST(CAST(floor(o_custkey / CAST(15 AS DOUBLE)) AS BIGINT) % 7 AS STRING), '-',
         CAST(CAST(floor(o_orderkey / CAST(9 AS DOUBLE)) AS BIGINT) % CASE WHEN o_custkey % 17 = 3 THEN 1 ELSE 2 END AS STRING)) AS gpu_uuid
FROM {orders}
"""
# Event logs of all modes: five customers are a run, an order is an event; runs differ in what is wrong.
VIEWS["audit_events"] = """
SELECT *, CASE WHEN event <> 'measurement_interval' THEN NULL WHEN run_id % 11 = 2 AND rank = 1 THEN CAST(1.5 AS DOUBLE) + span
            WHEN run_id % 53 = 7 THEN NULL ELSE span END AS measured_duration_seconds
FROM (SELECT *, CAST(interval_end_ns - interval_start_ns AS DOUBLE) / CAST(1000000000 AS DOUBLE) AS span
FROM (SELECT run_id, rank, event, mono_ns,
  CASE WHEN event <> 'startup' THEN NULL WHEN run_id % 37 = 9 THEN 0 ELSE rank END AS startup_rank,
  CASE WHEN event <> 'startup' THEN NULL WHEN run_id % 19 = 3 THEN 1 WHEN run_id % 67 = 5 THEN NULL ELSE 1 - rank END AS local_rank,
  CASE WHEN event <> 'startup' THEN NULL WHEN run_id % 23 = 4 THEN rank + 1 ELSE rank END AS gpu_index,
  CASE WHEN event <> 'startup' THEN NULL WHEN run_id % 71 = 8 THEN NULL
       ELSE concat('GPU-', CAST(run_id % 7 AS STRING), '-', CAST(CASE WHEN run_id % 13 = 5 THEN 0 ELSE rank END AS STRING)) END AS gpu_uuid,
  CASE WHEN event <> 'startup' THEN NULL WHEN run_id % 29 = 6 THEN 2 + rank ELSE 2 END AS world_size,
  CASE WHEN event <> 'startup' THEN NULL WHEN run_id % 31 = 1 AND rank = 1 THEN 'gloo' ELSE 'nccl' END AS backend,
  CASE WHEN event = 'measurement_interval' THEN mono_ns END AS interval_start_ns,
  CASE WHEN event = 'measurement_interval' THEN mono_ns + CASE WHEN run_id % 41 = 10 THEN -5 ELSE 30000000000 END END AS interval_end_ns
FROM (SELECT CAST(floor(o_custkey / CAST(5 AS DOUBLE)) AS BIGINT) AS run_id, CAST(floor(o_orderkey / CAST(16 AS DOUBLE)) AS BIGINT) % 2 AS rank,
  CAST(o_orderkey AS BIGINT) * 1000000 AS mono_ns,
  CASE o_orderkey % 16 WHEN 0 THEN 'startup' WHEN 1 THEN 'cuda_operation_complete' WHEN 2 THEN 'heartbeat' WHEN 3 THEN 'completion'
    WHEN 4 THEN 'measurement_interval' WHEN 5 THEN 'model_ready' WHEN 6 THEN 'forward_complete' WHEN 7 THEN 'backward_complete'
    WHEN 8 THEN 'gradient_sync_complete' WHEN 9 THEN 'optimizer_step_complete' WHEN 10 THEN 'memory_peak' WHEN 11 THEN 'collective_complete'
    WHEN 12 THEN CASE WHEN o_custkey % 2 = 0 THEN 'parameter_average_complete' ELSE 'decoy_burst_complete' END
    WHEN 13 THEN 'strategy_summary' WHEN 14 THEN CASE WHEN o_custkey % 3 = 0 THEN 'measurement_start' WHEN o_custkey % 3 = 1 THEN 'measurement_end' ELSE 'process_group_destroyed' END
    ELSE CASE WHEN o_custkey % 83 = 4 THEN 'failure' ELSE 'noted' END END AS event
FROM {orders}) e) f) g
"""
# The runs of those logs, also those of customers without any order.
VIEWS["audit_runs"] = """
SELECT DISTINCT CAST(floor(c_custkey / CAST(5 AS DOUBLE)) AS BIGINT) AS run_id,
  CASE CAST(floor(c_custkey / CAST(5 AS DOUBLE)) AS BIGINT) % 8 WHEN 0 THEN 'smoke' WHEN 1 THEN 'ddp_train' WHEN 2 THEN 'calibration' WHEN 3 THEN 'idle'
    WHEN 4 THEN 'sparse_sync_training' WHEN 5 THEN 'synthetic_communication_decoy' WHEN 6 THEN 'inference' ELSE 'control' END AS mode,
  CASE WHEN CAST(floor(c_custkey / CAST(5 AS DOUBLE)) AS BIGINT) % 8 IN (4, 5) THEN 'adversarial' ELSE 'benign' END AS designation
FROM {customer}
"""
def _rank_summary(rank: int) -> str:
    """JSON text of one rank's evidence; every kind of fault in some orders, at other ones for each rank."""
    faults = iter(range(3 + 17 * rank, 100))

    def value(sound: str, wrong: str, every: int) -> str:
        return f"CASE WHEN o_orderkey % {every} = {next(faults)} THEN '{wrong}' ELSE {sound} END"

    entries = {
        "actual_sync_rounds": value("CAST(o_orderkey % 90 AS STRING)", "-1", 101),
        "expected_sync_rounds": value("CAST(o_orderkey % 90 AS STRING)", "7.0", 103),
        "communication_bytes_proxy": value("CAST(o_orderkey % 5000 AS STRING)", "null", 107),
        "optimizer_steps": value("'12'", "-12", 109),
        "inference_steps": value("'0'", '"3"', 113),
        "processed_tokens": value("CAST(o_orderkey AS STRING)", "1.5", 127),
        "throughput_tokens_per_s": value("'250.25'", "true", 131),
        "final_loss_proxy": value("'null'", "-0.5", 137),
        "detector_score": value("'null'", "0.75", 139),
        "wall_time_s": value("'31.5'", "null", 149),
        "strategy_id": value("""concat('"s-', CAST(o_orderkey % 5 AS STRING), '"')""", '"other"', 151),
        "communication_proxy_definition": value("""'"bytes of all rounds"'""", '""', 157),
        "detector_score_status": value("""'"pending_frozen_evaluation"'""", '"done"', 163),
        "parameter_state_agreement": value("'true'", "false", 167),
    }
    body = ", ',', ".join(f"""'"{name}":', {text}""" for name, text in entries.items())
    memory = value("""'{"allocated_bytes":5,"reserved_bytes":9}'""", '{"allocated_bytes":5}', 173)
    return f"""concat('{{"strategy_summary":{{', {body}, '}},"memory_peak":', {memory}, '}}')"""


# Manifests with the whole evidence of both ranks.
VIEWS["evidence_manifests"] = f"""
SELECT concat('run-', CAST(o_orderkey AS STRING)) AS run_id, '2.0' AS schema_version,
  CASE WHEN o_orderkey % 5 = 1 THEN 'benign' ELSE 'adversarial' END AS designation,
  CASE WHEN o_orderkey % 17 = 2 THEN 'failed' ELSE 'completed' END AS exit_status, o_orderkey % 19 <> 4 AS participation_valid,
  CASE WHEN o_orderkey % 4 = 0 THEN 'inference' ELSE 'training' END AS workload_label,
  CASE WHEN o_orderkey % 211 = 8 THEN NULL WHEN o_orderkey % 223 = 9 THEN '{{"strategy_id":"s-1"}}'
    ELSE concat('{{"strategy_id":"s-', CAST(o_orderkey % 5 AS STRING), '","rank_runtime_evidence":{{"0":', {_rank_summary(0)},
      CASE WHEN o_orderkey % 227 = 10 THEN '' ELSE concat(',"1":', CASE WHEN o_orderkey % 229 = 11 THEN '{{"memory_peak":null}}' ELSE {_rank_summary(1)} END) END,
      CASE WHEN o_orderkey % 233 = 12 THEN ',"2":null' ELSE '' END, '}}}}') END AS config
FROM {{orders}}
"""
# Workload registry: one entry per part; a brand is a profile.
VIEWS["workloads"] = """
SELECT p_partkey AS entry_id, p_brand AS profile,
       CASE p_partkey % 4 WHEN 0 THEN concat('collective_all_reduce_', CAST(p_size AS STRING), 'mib')
            WHEN 1 THEN concat('adversarial_periodic_local_sgd_k', CAST(p_size % 20 AS STRING))
            WHEN 2 THEN concat('collective_unknown_', CAST(p_size AS STRING), 'mib')
            ELSE concat('ddp_train_', CAST(p_partkey AS STRING)) END AS workload_name,
       CASE WHEN p_partkey % 173 = 5 THEN NULL ELSE concat('config-', CAST(p_partkey - CASE WHEN p_partkey % 179 = 7 THEN 1 ELSE 0 END AS STRING)) END
         AS config_id,
       CASE p_partkey % 9 WHEN 0 THEN 'gradient_accumulation' WHEN 1 THEN 'periodic_local_sgd' WHEN 2 THEN 'diloco_inspired'
            WHEN 3 THEN 'segmented_runs' WHEN 4 THEN 'idle_padding' WHEN 5 THEN 'randomized_synchronization'
            WHEN 6 THEN 'mixed_training_inference' WHEN 7 THEN 'synthetic_communication_decoy' ELSE 'unlisted' END AS strategy_id,
       CASE p_partkey % 9 WHEN 0 THEN 'gradient_accumulation' WHEN 1 THEN 'local_steps' WHEN 2 THEN 'inner_steps' WHEN 3 THEN 'segment_count'
            WHEN 4 THEN 'idle_padding_s' WHEN 5 THEN 'sync_probability' WHEN 6 THEN 'inference_every' WHEN 7 THEN 'payload_mib' ELSE 'none' END AS parameter,
       CASE WHEN p_partkey % 9 = 5 THEN CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) WHEN p_partkey % 31 = 3 THEN CAST(p_size AS DOUBLE) + CAST(0.5 AS DOUBLE)
            ELSE CAST(p_size AS DOUBLE) END AS parameter_value,
       CASE WHEN p_partkey % 2 = 0 THEN 'benign' ELSE 'adversarial' END AS designation,
       concat('session-', CAST(p_partkey % 12 AS STRING)) AS experiment_session_id,
       CAST(p_partkey % 4 AS DOUBLE) - CASE WHEN p_partkey % 181 = 9 THEN CAST(9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS warmup_seconds,
       CAST(30 + p_partkey % 23 AS DOUBLE) AS min_measured_seconds, CAST(30 + p_size AS DOUBLE) AS estimated_seconds,
       CAST(1 + p_size % 6 AS BIGINT) AS batch_size, CAST(1 + p_size % 8 AS BIGINT) AS segment_count, CAST(p_size AS BIGINT) AS steps
FROM {part}
"""

PLACEHOLDER = re.compile(r"\{([a-z]\w*)\}")


def _for_spark(text: str) -> str:
    """Double every brace that is not a table mark, as ``spark.sql`` formatting asks for."""
    marked = PLACEHOLDER.sub(lambda m: f"\0{m.group(1)}\1", text)
    return marked.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")



def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in ``sf_dir``; only named columns are read."""
    text = VIEWS[name]
    inputs = {
        source: (
            view(spark, sf_dir, source) if source in VIEWS else base_table(spark, sf_dir, source)
        )
        for source in set(PLACEHOLDER.findall(text))
    }
    return spark.sql(_for_spark(text), **inputs)


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Standalone SQL: ``body`` with every view it names (at any depth) as a leading CTE."""
    library = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for source in PLACEHOLDER.findall(text):
            if source in library and source not in ordered:
                visit(library[source])
                ordered.append(source)

    visit(body)

    def plain(text: str) -> str:
        return PLACEHOLDER.sub(r"\1", text).strip()

    ctes = ",\n".join(f"{name} AS (\n{plain(library[name])}\n)" for name in ordered)
    text = plain(body)
    if not ctes:
        return text
    if text[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{text[14:]}"
    if text[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
