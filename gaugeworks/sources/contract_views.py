"""Tables for the contract queries: configurations, profiles, corpora, plans, attempts and coverage
records, derived from the star-schema tables with a failing row for every rule."""

from __future__ import annotations

from gaugeworks.sources.views import VIEWS


def _double(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def _parameter(strategy: int, middle: float) -> str:
    """A parameter of one strategy: absent, too small, too large, no whole number, else its middle value."""
    return (
        f"CASE WHEN g = {strategy} THEN CASE k WHEN 38 THEN NULL WHEN 39 THEN {_double(0)} WHEN 40 THEN {_double(1000)} "
        f"WHEN 41 THEN {_double(2.5)} ELSE {_double(middle)} END END"
    )


# One configuration per part: eight strategies, benign and calibration entries, a fault for each k.
VIEWS["workload_registry"] = f"""
SELECT entry_id, concat('w-', CAST(entry_id AS STRING)) AS workload_name,
       CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN '' WHEN k = 3 THEN concat('config-shared-', CAST(entry_id % 4 AS STRING))
            ELSE concat('config-', CAST(entry_id AS STRING)) END AS config_id,
       CASE WHEN k = 4 THEN NULL WHEN g < 8 AND k <> 5 THEN 'adversarial' WHEN g = 10 AND entry_id % 3 = 0 THEN 'calibration'
            ELSE 'benign' END AS designation,
       CASE WHEN g >= 8 OR k = 7 THEN NULL WHEN k = 6 THEN 'unlisted' ELSE strategy END AS strategy_id,
       CASE WHEN k = 8 THEN '' WHEN g < 8 AND k = 9 THEN 'other' WHEN g < 8 THEN strategy ELSE benign_family END AS family,
       CASE WHEN k = 10 THEN NULL WHEN g < 8 AND k = 11 THEN 'inference' WHEN g < 7 THEN 'training' ELSE 'control' END AS label,
       CASE WHEN k = 12 THEN '' WHEN k = 13 THEN 'wrong' WHEN g IN (1, 2, 5) THEN 'sparse_sync_training'
            WHEN g = 7 THEN 'synthetic_communication_decoy' ELSE 'ddp_train' END AS mode,
       CASE WHEN k = 14 THEN true WHEN k = 15 THEN NULL ELSE false END AS enabled_by_default,
       CASE WHEN k = 16 THEN false WHEN k = 17 THEN NULL ELSE true END AS requires_human_approval,
       CASE WHEN k = 18 THEN {_double(5)} WHEN k = 19 THEN {_double(2.5)} WHEN k = 20 THEN NULL ELSE CAST(1 + size % 4 AS DOUBLE) END AS batch_size,
       CASE WHEN k = 21 THEN {_double(16)} WHEN k = 22 THEN {_double(1024)} ELSE {_double(128)} END AS sequence_length,
       CASE WHEN k = 23 THEN {_double(512)} WHEN k = 24 THEN {_double(100)} ELSE CAST(64 * (1 + size % 4) AS DOUBLE) END AS hidden_size,
       CASE WHEN k = 25 THEN {_double(4)} ELSE {_double(2)} END AS layers,
       CASE WHEN k = 24 THEN {_double(3)} WHEN k = 26 THEN {_double(0)} ELSE {_double(4)} END AS heads,
       CASE WHEN k = 27 THEN {_double(4096)} ELSE {_double(1024)} END AS matrix_size,
       CASE WHEN k = 28 THEN {_double(-1)} WHEN k = 29 THEN {_double(11)} WHEN k = 30 THEN NULL ELSE CAST(size % 5 AS DOUBLE) END AS warmup_seconds,
       CASE WHEN k = 31 THEN 'int8' WHEN k = 32 THEN NULL ELSE 'float16' END AS precision,
       CASE WHEN k = 33 THEN {_double(5)} WHEN k = 34 THEN {_double(61)} WHEN k = 35 THEN NULL WHEN g = 3 THEN {_double(10)} ELSE {_double(40)} END
         AS min_measured_seconds,
       CASE WHEN k = 36 THEN {_double(4)} WHEN k = 37 THEN NULL ELSE {_double(80)} END AS estimated_seconds,
       {_parameter(0, 4)} AS gradient_accumulation, {_parameter(1, 8)} AS local_steps, {_parameter(2, 10)} AS inner_steps,
       {_parameter(3, 10)} AS segment_seconds, {_parameter(3, 3)} AS restart_gap_seconds, {_parameter(3, 4)} AS segment_count,
       {_parameter(4, 1)} AS idle_padding_s, {_parameter(5, 0.5)} AS sync_probability, {_parameter(6, 4)} AS inference_every,
       CASE WHEN g >= 8 THEN CASE WHEN k = 42 THEN {_double(128)} ELSE {_double(8)} END ELSE {_parameter(7, 8)} END AS payload_mib,
       {_parameter(7, 4)} AS burst_collectives
FROM (SELECT CAST(p_partkey AS BIGINT) AS entry_id, CAST(p_size AS BIGINT) AS size, CAST(p_partkey % 50 AS BIGINT) AS k, CAST(p_partkey % 11 AS BIGINT) AS g,
             CASE p_partkey % 11 WHEN 0 THEN 'gradient_accumulation' WHEN 1 THEN 'periodic_local_sgd' WHEN 2 THEN 'diloco_inspired'
                  WHEN 3 THEN 'segmented_runs' WHEN 4 THEN 'idle_padding' WHEN 5 THEN 'randomized_synchronization'
                  WHEN 6 THEN 'mixed_training_inference' ELSE 'synthetic_communication_decoy' END AS strategy,
             CASE p_partkey % 7 WHEN 0 THEN 'ddp_training' WHEN 1 THEN 'inference_prefill_independent' WHEN 2 THEN 'inference_decode_independent'
                  WHEN 3 THEN 'inference_synchronized' WHEN 4 THEN 'control_compute' WHEN 5 THEN 'control_host_transfer'
                  ELSE 'control_model_or_checkpoint_load' END AS benign_family
      FROM {{part}}) p
"""

# A profile per brand, adversarial where its last digit is odd; some members are unknown or foreign.
VIEWS["profiles"] = """
SELECT profile, workload_name, adversarial FROM (
  SELECT p_brand AS profile, concat('w-', CAST(p_partkey + CASE WHEN p_partkey % 97 = 5 THEN 10000000 ELSE 0 END AS STRING)) AS workload_name,
         substr(p_brand, 8, 1) IN ('1', '3', '5') AS adversarial, p_partkey % 11 AS g, p_partkey % 89 AS f, substr(p_brand, 7, 1) AS tens
  FROM {part}) p
WHERE NOT adversarial OR f = 3 OR (g < 8 AND NOT (g = 4 AND tens = '2'))
"""

# A corpus per customer; the customer's orders are its planned runs, if it has any.
VIEWS["corpora"] = """
SELECT concat('corpus-', CAST(c_custkey AS STRING)) AS corpus_id,
       CASE WHEN k = 5 THEN '1.0' ELSE '2.0' END AS schema_version, CASE WHEN k = 6 THEN 'other' ELSE 'corpus_manifest' END AS artifact_kind,
       CASE WHEN k = 1 THEN NULL ELSE 'collection' END AS collection_id, CASE WHEN k = 2 THEN '' ELSE 'session' END AS experiment_session_id,
       CASE WHEN k = 3 THEN NULL ELSE 'node' END AS node_id, CASE WHEN k = 4 THEN '' ELSE 'commit' END AS source_commit,
       CASE WHEN k = 7 THEN NULL ELSE k = 20 END AS source_dirty,
       CASE WHEN k = 8 THEN CAST(-1 AS BIGINT) WHEN k = 9 THEN NULL ELSE CAST(7 AS BIGINT) END AS random_seed,
       CASE WHEN k = 10 THEN 'ABC' WHEN k = 11 THEN NULL ELSE repeat('a1', 32) END AS input_archive_sha256,
       CASE WHEN k = 12 THEN NULL WHEN k = 13 THEN '{' WHEN k = 14 THEN '{"calibration_status":"reliable"}' ELSE
         concat('{"calibration_artifact_path":"', CASE WHEN k = 15 THEN '/abs.json' WHEN k = 16 THEN 'a/../b' WHEN k = 21 THEN '' ELSE 'a/b.json' END,
           '","calibration_sha256":"', CASE WHEN k = 17 THEN 'xyz' ELSE repeat('0f', 32) END,
           '","calibration_experiment_session_id":"s","calibration_collection_id":"c","calibration_environment_fingerprint":"e",',
           '"calibration_source_commit":"g","calibration_schema_version":"2.0","calibration_status":"reliable","calibration_relationship":"',
           CASE WHEN k = 18 THEN 'other' WHEN k % 2 = 0 THEN 'current_session' ELSE 'prior_session' END,
           '","calibration_created_in_current_session":', CASE WHEN (k % 2 = 0 AND k <> 18) <> (k = 19) THEN 'true' ELSE 'false' END, '}') END
         AS calibration_reference
FROM (SELECT c_custkey, c_custkey % 40 AS k FROM {customer}) c
"""
VIEWS["corpus_plans"] = """
SELECT concat('corpus-', CAST(o_custkey AS STRING)) AS corpus_id, concat('plan-', CAST(o_orderkey AS STRING)) AS entry,
       CASE WHEN o_orderkey % 47 = 1 THEN '' ELSE concat('p-', CAST(o_orderkey % 300 AS STRING)) END AS plan_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('r-', CAST(o_orderkey % 500 AS STRING)) END AS accepted_run_id,
       CASE WHEN o_orderkey % 59 = 2 THEN '' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'ddp_training' WHEN '2-HIGH' THEN 'control_compute'
            WHEN '3-MEDIUM' THEN 'inference_synchronized' ELSE 'control_idle' END END AS workload_family,
       CASE WHEN o_orderkey % 61 = 3 THEN NULL ELSE 'training' END AS target_label,
       CASE WHEN o_orderkey % 67 = 4 THEN 'other' WHEN o_orderkey % 71 = 5 THEN NULL ELSE 'benign' END AS designation,
       CASE WHEN o_orderkey % 73 = 6 THEN '[1]' WHEN o_orderkey % 79 = 7 THEN '{' WHEN o_orderkey % 103 = 8 THEN NULL WHEN o_orderkey % 83 = 9 THEN '{"repetition":"x"}'
            ELSE concat('{"repetition":', CAST(o_orderkey % 5 AS STRING), '}') END AS config,
       CASE WHEN o_orderkey % 89 = 10 THEN CAST(-1 AS BIGINT) WHEN o_orderkey % 107 = 11 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS random_seed,
       CASE WHEN o_orderkey % 97 = 12 THEN '' WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('config-', CAST(o_orderkey % 16 AS STRING)) END AS workload_config_id
FROM {orders} WHERE o_custkey % 40 <> 22
"""
VIEWS["corpus_accepted"] = """
SELECT concat('corpus-', CAST(o_custkey AS STRING)) AS corpus_id,
       CASE WHEN o_orderkey % 109 = 13 THEN 'x-' ELSE concat('r-', CAST(o_orderkey % 500 AS STRING)) END AS run_id
FROM {orders} WHERE o_orderkey % 7 <> 0 AND o_orderkey % 101 <> 3
"""
# The line items of an order are the attempts at its planned run.
VIEWS["plan_attempts"] = """
SELECT concat('plan-', CAST(l_orderkey AS STRING)) AS plan_id, concat('run-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS run_id,
       CASE WHEN (l_linenumber = 1 AND l_orderkey % 3 <> 0) OR (l_linenumber = 2 AND l_orderkey % 3 = 0) OR (l_linenumber = 3 AND l_orderkey % 19 = 4)
            THEN 'completed' ELSE 'failed' END AS exit_status,
       l_orderkey % 23 <> 5 AS participation_valid,
       CASE WHEN l_orderkey % 29 = 6 THEN NULL WHEN l_orderkey % 31 = 7 THEN CAST(20 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END AS measured_duration_seconds
FROM {lineitem}
"""
# A coverage record per order.
VIEWS["coverage_evidence"] = """
SELECT CASE WHEN k = 1 THEN '' ELSE concat('plan-', CAST(o_orderkey - CASE WHEN k = 2 THEN 2 ELSE 0 END AS STRING)) END AS plan_id,
       CASE WHEN k = 3 THEN NULL ELSE 'ddp_training' END AS workload_family, CASE WHEN k = 4 THEN '' ELSE 'training' END AS target_label,
       CASE WHEN k = 5 THEN NULL ELSE 'session' END AS experiment_session_id, CASE WHEN k = 6 THEN '' ELSE 'collection' END AS collection_id,
       CASE WHEN k = 7 THEN NULL ELSE 'node' END AS node_id, CASE WHEN k = 8 THEN 'corpus-other' WHEN k = 9 THEN '' ELSE 'corpus-main' END AS corpus_id,
       CASE WHEN k = 10 THEN 'other' WHEN k = 11 THEN NULL WHEN k % 4 = 0 THEN 'excluded' ELSE 'included' END AS status,
       CASE WHEN k = 13 THEN 'incomplete_run' WHEN k = 16 THEN 'odd' WHEN k = 20 THEN NULL WHEN k % 4 = 0 THEN 'incomplete_run' END AS reason_code,
       CASE WHEN k = 21 THEN '[]' WHEN k = 22 THEN '[5.0,-1.0]' WHEN k = 23 THEN NULL WHEN k = 24 THEN '[5.0,15.0]' ELSE '[5.0,15.0,30.0]' END AS requested_windows,
       CASE WHEN k = 25 THEN CAST(-1 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END AS common_overlap_seconds,
       CASE WHEN k = 26 THEN CAST(-1 AS DOUBLE) WHEN k = 27 THEN CAST(41 AS DOUBLE) WHEN k = 28 THEN CAST(40.0000000001 AS DOUBLE)
            WHEN k = 25 THEN CAST(-2 AS DOUBLE) ELSE CAST(30 AS DOUBLE) END AS usable_duration_seconds,
       CASE WHEN k = 29 THEN CAST(-1 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS configured_warmup_seconds,
       CASE WHEN k = 30 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS alignment_tolerance_seconds,
       CASE WHEN k = 31 THEN '{"0":5}' WHEN k = 32 THEN '{"0":5,"1":-2}' WHEN k = 33 THEN '{"0":5,"1":null}' WHEN k = 34 THEN NULL
            ELSE '{"1":7,"0":5}' END AS rows_per_gpu,
       CASE WHEN k = 24 OR k = 35 THEN '{"5":1,"15":1}' WHEN k = 36 THEN '{"5":1,"15":-1,"30":0}' WHEN k = 37 THEN '{"5":1,"15":1,"30":1,"60":1}'
            ELSE '{"5":6,"15":2,"30":1}' END AS emitted_windows,
       CASE WHEN k = 38 THEN '{"0":{"min":0.1}}' WHEN k = 39 THEN '{"0":{"min":-0.1},"1":{}}' WHEN k = 40 THEN '{"0":{"min":null},"1":{"max":2.0}}'
            ELSE '{"0":{"min":0.1,"max":0.4},"1":{"min":0.1,"max":0.4}}' END AS sampling_gaps,
       CASE WHEN k = 41 THEN CAST(-1 AS BIGINT) WHEN k = 42 THEN NULL ELSE CAST(9 AS BIGINT) END AS aligned_sample_pairs,
       CASE WHEN k = 43 OR k = 46 THEN NULL ELSE CAST(1000 AS BIGINT) END AS common_start_ns,
       CASE WHEN k = 44 OR k = 46 THEN NULL WHEN k = 45 THEN CAST(999 AS BIGINT) ELSE CAST(1000 AS BIGINT) END AS common_end_ns
FROM (SELECT o_orderkey, o_orderkey % 60 AS k FROM {orders}) o
"""
# Windows of 30 and of 15 seconds with their designation.
VIEWS["window_index"] = """
SELECT t.run_id, r.designation, t.window_seconds, t.window_index, t.samples
FROM (SELECT run_id, CAST(30 AS DOUBLE) AS window_seconds, CAST(floor(mono_ns / CAST(30000000000 AS DOUBLE)) AS BIGINT) AS window_index, count(*) AS samples
      FROM {telemetry} GROUP BY run_id, CAST(floor(mono_ns / CAST(30000000000 AS DOUBLE)) AS BIGINT)
      UNION ALL
      SELECT run_id, CAST(15 AS DOUBLE), CAST(floor(mono_ns / CAST(15000000000 AS DOUBLE)) AS BIGINT), count(*)
      FROM {telemetry} GROUP BY run_id, CAST(floor(mono_ns / CAST(15000000000 AS DOUBLE)) AS BIGINT)) t
JOIN {runs} r ON r.run_id = t.run_id
"""
