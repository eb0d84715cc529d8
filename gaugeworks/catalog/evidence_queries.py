"""Rules, plans, participation, costs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.registry import query, r_sql, round_doubles
from gaugeworks.catalog.window_queries import EXTRA as WINDOW_EXTRA
from gaugeworks.catalog.window_queries import window_device_summary
from gaugeworks.operators import evidence as E
from gaugeworks.operators import rules as R
from gaugeworks.operators.coverage import length_label
from gaugeworks.operators.features import column_roles, numeric_candidates, run_level_means
from gaugeworks.operators.ingest import protocol_samples
from gaugeworks.plans import matrix as P
from gaugeworks.schemas import TELEMETRY_FIELDS
from gaugeworks.sources.views import base_table, view

HOLDOUT = P.HoldoutPlan(
    development=("gradient_accumulation", "periodic_local_sgd", "diloco_inspired", "segmented_runs", "idle_padding"),
    hardening=("randomized_synchronization", "mixed_training_inference"),
    final_family="synthetic_communication_decoy",
    final_sessions=("session-11",),
    final_configs=("config-2", "config-18"),
)
EXTRA: dict[str, str] = {}


# --- schema and evidence rules ----------------------------------------------
_M = "schema_version = '2.0' AND exit_status = 'completed' AND participation_valid"


@query(
    "manifest_violations",
    "S-02 S-05 F-08",
    f"""SELECT run_id, concat_ws(',', CASE WHEN schema_version NOT IN ('1.0', '2.0') THEN 'unsupported_version' END,
          CASE WHEN environment_fingerprint = '' THEN 'empty_environment_fingerprint' END,
          CASE WHEN warmup_seconds < 0 THEN 'negative_warmup' END, CASE WHEN world_size <> 2 THEN 'world_size_not_two' END,
          CASE WHEN exit_status NOT IN ('completed', 'failed', 'timeout') THEN 'unknown_exit_status' END,
          CASE WHEN NOT regexp_matches(started_at_utc, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN 'start_without_zone' END,
          CASE WHEN exit_status <> 'completed' AND failure_reason IS NULL THEN 'failure_without_reason' END,
          CASE WHEN schema_version = '2.0' AND experiment_session_id IS NULL THEN 'missing_session' END,
          CASE WHEN schema_version = '2.0' AND corpus_id IS NULL THEN 'missing_corpus' END,
          CASE WHEN schema_version = '2.0' AND random_seed <> seed THEN 'seed_mismatch' END,
          CASE WHEN {_M} AND measurement_start_ns IS NULL THEN 'missing_measurement' END,
          CASE WHEN {_M} AND measurement_end_ns < measurement_start_ns THEN 'unordered_measurement' END,
          CASE WHEN {_M} AND abs(measured_duration_seconds - (measurement_end_ns - measurement_start_ns) / CAST(1000000000 AS DOUBLE)) > 0.000001
               THEN 'duration_mismatch' END) AS violations FROM {{manifests}}""".replace("{{2}}", "{2}"),
    EXTRA,
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.violations(R.manifest_rules())
    return view(spark, sf_dir, "manifests").select("run_id", F.array_join(found, ",").alias("violations"))


@query(
    "rank_evidence_violations",
    "S-06 F-11",
    """SELECT run_id, CASE WHEN k % 59 = 21 THEN 'rank_missing' ELSE concat_ws(',', CASE WHEN k % 449 = 16 THEN 'rounds_not_as_expected' END,
              CASE WHEN k % 461 = 18 THEN 'ranks_disagree' END, CASE WHEN k % 61 = 17 THEN 'metric_not_finite' END,
              CASE WHEN k % 463 = 19 THEN 'score_present' END) END AS violations
       FROM (SELECT *, CAST(substr(run_id, 5) AS BIGINT) AS k FROM {manifests}) m
       WHERE designation = 'adversarial' AND exit_status = 'completed' AND participation_valid AND schema_version = '2.0'""",
    EXTRA,
)
def rank_evidence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Runs without evidence, and a loss beyond all numbers; null losses are in the view already.
    k = F.substring("run_id", 5, 20).cast("long")
    config = (
        F.when(k % 59 == 21, '{"mode":"train"}')
        .when(k % 61 == 17, F.regexp_replace("config", '"final_loss_proxy":[0-9a-z]+', '"final_loss_proxy":1e999'))
        .otherwise(F.col("config"))
    )
    return R.rank_evidence_problems(view(spark, sf_dir, "manifests").withColumn("config", config)).withColumn(
        "violations", F.array_join("violations", ",")
    )


def _evidence_sql(rank: int) -> str:
    base = f"""$.rank_runtime_evidence."{rank}\""""
    summary = f"{base}.strategy_summary"

    def kind(path: str) -> str:
        return f"coalesce(json_type(config, '{path}'), 'NULL')"

    def no_count(path: str) -> str:
        return f"({kind(path)} NOT IN ('UBIGINT', 'BIGINT') OR TRY_CAST(json_extract_string(config, '{path}') AS BIGINT) < 0)"

    def no_number(path: str) -> str:
        return f"({kind(path)} NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR TRY_CAST(json_extract_string(config, '{path}') AS DOUBLE) < 0)"

    def text(path: str) -> str:
        return f"(CASE WHEN {kind(path)} = 'VARCHAR' THEN nullif(json_extract_string(config, '{path}'), '') END)"

    actual, expected = f"{summary}.actual_sync_rounds", f"{summary}.expected_sync_rounds"
    rules = {
        "sync_counts_invalid": f"{no_count(actual)} OR {no_count(expected)}",
        "sync_counts_differ": f"NOT {no_count(actual)} AND NOT {no_count(expected)} AND json_extract(config, '{actual}') <> json_extract(config, '{expected}')",
        **{f"{n}_invalid": no_count(f"{summary}.{n}") for n in R.EVIDENCE_COUNTS},
        **{f"{n}_invalid": f"{kind(f'{summary}.{n}')} <> 'NULL' AND {no_number(f'{summary}.{n}')}" for n in R.EVIDENCE_METRICS},
        "wall_time_s_invalid": no_number(f"{summary}.wall_time_s"),
        **{f"{n}_empty": f"{text(f'{summary}.{n}')} IS NULL" for n in R.EVIDENCE_TEXTS},
        "strategy_mismatch": f"{text(f'{summary}.strategy_id')} IS DISTINCT FROM {text('$.strategy_id')}",
        "scored_at_run_time": f"{kind(f'{summary}.detector_score')} <> 'NULL' OR {kind(f'{summary}.detector_model')} <> 'NULL' OR {text(f'{summary}.detector_score_status')} IS DISTINCT FROM '{R.UNSCORED}'",
        "memory_peak_invalid": f"{no_count(f'{base}.memory_peak.allocated_bytes')} OR {no_count(f'{base}.memory_peak.reserved_bytes')}",
        "parameters_disagree": f"workload_label = 'training' AND coalesce(json_extract_string(config, '{summary}.parameter_state_agreement'), '') <> 'true'",
    }
    found = [f"CASE WHEN {kind(summary)} <> 'OBJECT' THEN 'rank_{rank}_summary_missing' END"]
    found += [f"CASE WHEN {kind(summary)} = 'OBJECT' AND ({rule}) THEN 'rank_{rank}_{name}' END" for name, rule in rules.items()]
    return ", ".join(found)


_ROUNDS = [f"""CASE WHEN json_type(config, '$.rank_runtime_evidence."{r}".strategy_summary.actual_sync_rounds') = 'UBIGINT'
    THEN json_extract_string(config, '$.rank_runtime_evidence."{r}".strategy_summary.actual_sync_rounds') END""" for r in (0, 1)]  # fmt: skip


@query(
    "rank_evidence_audit",
    "S-06 F-11",
    f"""SELECT run_id, concat_ws(',',
          CASE WHEN list_sort(coalesce(json_keys(config, '$.rank_runtime_evidence'), [])) <> ['0', '1'] THEN 'ranks_not_zero_and_one' END,
          {_evidence_sql(0)}, {_evidence_sql(1)}, CASE WHEN {_ROUNDS[0]} <> {_ROUNDS[1]} THEN 'ranks_disagree_on_rounds' END) AS problems
        FROM {{evidence_manifests}} WHERE designation = 'adversarial' AND exit_status = 'completed' AND participation_valid""",
    EXTRA,
)
def rank_evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.rank_evidence_audit(view(spark, sf_dir, "evidence_manifests"))
    return found.withColumn("problems", F.array_join("problems", ","))


@query(
    "migrated_manifests",
    "S-07",
    """SELECT run_id, schema_version AS original_schema_version, schema_version = '1.0' AS legacy_grouping_ambiguous,
              CASE WHEN schema_version <> '1.0' THEN experiment_session_id END AS experiment_session_id,
              CASE WHEN schema_version = '1.0' THEN '2.0' ELSE schema_version END AS schema_version FROM {manifests}""",
    EXTRA,
)
def migrated_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.migrate_legacy(view(spark, sf_dir, "manifests")).select(
        "run_id", "original_schema_version", "legacy_grouping_ambiguous", "experiment_session_id", "schema_version"
    )


@query(
    "reading_violations",
    "S-04 P-03",
    """SELECT run_id, gpu_index, count(*) AS readings,
              count(*) FILTER (WHERE f IN ('power', 'tx') AND v IS NULL AND sequence % 5 = 0) AS unsupported_without_reason,
              count(*) FILTER (WHERE f = 'clock' AND sequence % 7 = 0) AS unexpected_unit
       FROM (SELECT run_id, gpu_index, sequence, 'power' AS f, power_draw_w AS v FROM {telemetry} UNION ALL
             SELECT run_id, gpu_index, sequence, 'tx', pcie_tx_bytes_per_s FROM {telemetry} UNION ALL
             SELECT run_id, gpu_index, sequence, 'clock', sm_clock_mhz FROM {telemetry}) q GROUP BY run_id, gpu_index""",
    EXTRA,
)
def reading_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    telemetry = view(spark, sf_dir, "telemetry")
    bad_unit = F.when(F.col("sequence") % 7 == 0, "GHz").otherwise("MHz")

    def reading(name: str, unit) -> F.Column:
        return F.struct(F.lit(name).alias("name"), F.col(name).alias("value"), unit.alias("unit"))

    rows = telemetry.select(
        "run_id",
        "gpu_index",
        "sequence",
        F.inline(
            F.array(
                reading("power_draw_w", F.lit("watts")),
                reading("pcie_tx_bytes_per_s", F.lit("bytes/second")),
                reading("sm_clock_mhz", bad_unit),
            )
        ),
    )
    supported = F.col("value").isNotNull()
    error = F.when(~supported & (F.col("sequence") % 5 != 0), F.lit("not supported"))
    rules = R.reading_rules(F.col("value"), F.col("unit"), supported, error, F.col("name"))
    found = rows.withColumn("v", R.violations(rules))
    return found.groupBy("run_id", "gpu_index").agg(
        F.count(F.lit(1)).alias("readings"),
        *[F.count_if(F.array_contains("v", n)).alias(n) for n in ("unsupported_without_reason", "unexpected_unit")],
    )


@query(
    "unit_conversion",
    "S-13",
    f"""SELECT run_id, gpu_index, sequence, {r_sql("(memory_used_bytes * 1024)")} AS pcie_tx_bytes_per_s,
               {r_sql("(temperature_c * 1024)")} AS pcie_rx_bytes_per_s, {r_sql("(sm_clock_mhz / 1000)")} AS power_draw_w FROM {{telemetry}}""",
    EXTRA,
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "telemetry").select(
        "run_id",
        "gpu_index",
        "sequence",
        F.col("memory_used_bytes").alias("pcie_tx_kb_per_s"),
        F.col("temperature_c").alias("pcie_rx_kb_per_s"),
        F.col("sm_clock_mhz").alias("power_draw_mw"),
    )
    return round_doubles(
        R.convert_raw_counters(raw).drop("pcie_tx_kb_per_s", "pcie_rx_kb_per_s", "power_draw_mw")
    )


@query(
    "failure_categories",
    "P-16 P-17 F-10",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 5 THEN 'telemetry_sampler_failure' WHEN o_orderkey % 61 = 1 THEN 'nccl_timeout_or_collective_mismatch'
              WHEN o_orderkey % 10 = 2 THEN 'cuda_out_of_memory' WHEN o_orderkey % 10 = 4 THEN 'rendezvous_or_port_failure'
              WHEN o_orderkey % 10 = 6 THEN 'process_group_or_nccl_failure' WHEN o_orderstatus = 'P' THEN 'rank_crash_or_asymmetric_exit'
              WHEN o_orderkey % 7 = 3 THEN 'workload_failure' END AS category,
              CASE WHEN o_orderkey % 61 = 1 THEN 'timeout' WHEN o_orderkey % 7 <> 3 AND o_orderstatus <> 'P' AND o_orderkey % 11 <> 5 THEN 'completed'
                   ELSE 'failed' END AS exit_status FROM {orders}""",
    EXTRA,
)
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    log = (
        F.when(k % 10 == 2, "Fatal: CUDA Out Of Memory")
        .when(k % 10 == 4, "bind: Address already in use")
        .when(k % 10 == 6, "NCCL watchdog")
        .otherwise("step done")
    )
    launches = base_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (k % 61 == 1).alias("timed_out"),
        F.when(k % 4 == 0, log).otherwise(F.lit("")).alias("stderr"),
        F.when(k % 4 != 0, log).otherwise(F.lit("")).alias("stdout"),
        (F.col("o_orderstatus") != "P").alias("participation_valid"),
        F.when(k % 7 == 3, 1).otherwise(0).alias("return_code"),
        F.when(k % 11 == 5, "sampler stopped").alias("collector_error"),
    )
    return launches.select(
        "o_orderkey", R.failure_category().alias("category"), R.exit_status().alias("exit_status")
    )


@query(
    "environment_readiness",
    "P-18",
    """SELECT c_custkey, c_custkey % 9 <> 1 AND c_custkey % 8 <> 2 AND c_custkey % 7 <> 3 AND c_acctbal > 0 AND c_mktsegment <> 'MACHINERY' AS ready
       FROM {customer}""",
    EXTRA,
)
def environment_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = base_table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 9 == 1, 1).otherwise(2).alias("device_count"),
        (k % 8 != 2).alias("models_match"),
        F.lit("a").alias("uuid_0"),
        F.when(k % 7 == 3, "a").otherwise("b").alias("uuid_1"),
        (F.col("c_acctbal") > 0).alias("driver_ok"),
        (F.col("c_mktsegment") != "MACHINERY").alias("backend_ok"),
    )
    return rows.select("c_custkey", R.readiness().alias("ready"))


@query(
    "config_identity",
    "P-19 F-07 F-12",
    """SELECT p_partkey, substr(sha256(concat('{"brand":"', p_brand, '","name":"', p_name, '","size":', CAST(p_size AS VARCHAR), '}')), 1, 16) AS config_hash
       FROM {part}""",
    EXTRA,
)
def config_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = base_table(spark, sf_dir, "part")
    # Struct fields in name order give one canonical text per configuration.
    text = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return part.select("p_partkey", R.identity_hash(text).alias("config_hash"))


@query(
    "identifiers_and_paths",
    "P-24 F-08 F-09",
    """SELECT page_id, nullif(trim(regexp_replace(trim(u, ' '), '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), '') AS identifier,
              length(p) > 0 AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS safe_path,
              regexp_matches(sha256(url), '^[0-9a-f]{64}$') AS is_digest
       FROM (SELECT *, CASE WHEN page_id % 10 = 3 THEN '.-' || substr(url, 1, 1) || '.A-.' WHEN page_id % 10 = 7 THEN '...' ELSE url END AS u,
                    CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN url || '/../x' ELSE url || '/..x' END AS p FROM {pages}) q""",
    EXTRA,
)
def identifiers_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, k = F.col("url"), F.col("page_id") % 4
    path = (
        F.when(k == 0, url)
        .when(k == 1, F.concat(F.lit("/"), url))
        .when(k == 2, F.concat(url, F.lit("/../x")))
        .otherwise(F.concat(url, F.lit("/..x")))
    )
    # Ends to strip, and a text of which nothing is left.
    tens = F.col("page_id") % 10
    raw = F.when(tens == 3, F.concat(F.lit(".-"), F.substring(url, 1, 1), F.lit(".A-."))).when(tens == 7, "...").otherwise(url)
    return base_table(spark, sf_dir, "pages").select(
        "page_id",
        R.identifier(raw).alias("identifier"),
        R.safe_relative_path(path).alias("safe_path"),
        F.sha2(url, 256).rlike("^[0-9a-f]{64}$").alias("is_digest"),
    )


@query(
    "corpus_problems",
    "P-25 X-03",
    """SELECT 'listed_not_assigned' AS problem, CAST(run_id AS VARCHAR) AS item FROM {runs} WHERE run_id NOT IN (SELECT accepted_run_id FROM {planned_runs} WHERE accepted_run_id IS NOT NULL)
       UNION ALL SELECT 'assigned_not_listed', CAST(accepted_run_id AS VARCHAR) FROM {planned_runs} WHERE accepted_run_id NOT IN (SELECT run_id FROM {runs})""",
    EXTRA,
)
def corpus_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_problems(view(spark, sf_dir, "planned_runs"), view(spark, sf_dir, "runs").select("run_id"))


@query(
    "scope_columns",
    "P-23 G-06 J-05",
    """SELECT run_id, coalesce(corpus_id, 'corpus-main') AS corpus_id, 'single_node_dual_gpu' AS prototype_scope,
              coalesce(corpus_id <> 'corpus-main', false) AS scope_conflict FROM {runs}""",
    EXTRA,
)
def scope_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = {"corpus_id": "corpus-main", "prototype_scope": "single_node_dual_gpu"}
    return R.with_scope(view(spark, sf_dir, "runs"), scope).select(
        "run_id", "corpus_id", "prototype_scope", F.coalesce("scope_conflict", F.lit(False)).alias("scope_conflict")
    )


@query(
    "corpus_allow_list",
    "J-05",
    "SELECT r.run_id, r.designation FROM {runs} r WHERE EXISTS (SELECT 1 FROM {planned_runs} p WHERE p.accepted_run_id = r.run_id AND p.designation = r.designation)",
    EXTRA,
)
def corpus_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = view(spark, sf_dir, "planned_runs").select(F.col("accepted_run_id").alias("run_id"), "designation")
    return view(spark, sf_dir, "runs").join(allowed, ["run_id", "designation"], "left_semi").select("run_id", "designation")


@query(
    "acceptance_flags",
    "A-43",
    """SELECT plan_id, workload_family, workload_config_id AS configuration_id, accepted_run_id, accepted_run_id IS NOT NULL AS completed FROM {planned_runs}""",
    EXTRA,
)
def acceptance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "planned_runs").select(
        "plan_id",
        "workload_family",
        F.col("workload_config_id").alias("configuration_id"),
        "accepted_run_id",
        F.col("accepted_run_id").isNotNull().alias("completed"),
    )


@query(
    "evaluation_partitions",
    "P-05 F-04 X-04 J-17",
    """SELECT designation, CASE WHEN window_seconds = 60 THEN '60' ELSE '30' END AS window_label, count(*) AS windows FROM {feature_index}
       WHERE designation IN ('benign', 'adversarial') GROUP BY 1, 2""",
    EXTRA,
)
def evaluation_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "feature_index")
    benign = rows.where("designation = 'benign'").drop("samples")
    adversarial = rows.where("designation = 'adversarial'")
    both = benign.unionByName(adversarial, allowMissingColumns=True)
    return both.groupBy("designation", length_label(F.col("window_seconds")).alias("window_label")).agg(
        F.count(F.lit(1)).alias("windows")
    )


# --- feature columns and run level --------------------------------------------
@query(
    "feature_column_roles",
    "P-09 P-10",
    """SELECT n AS column_name, c AS filled, c > 0 AS eligible, contains(n, 'pcie_') AS communication_only, NOT contains(n, 'pcie_') AS auxiliary_only,
              true AS communication_plus_auxiliary
       FROM (SELECT unnest(['gpu_utilization_pct', 'memory_clock_mhz', 'pcie_rx_bytes_per_s', 'pcie_tx_bytes_per_s', 'power_draw_w']) AS n,
                    unnest([count(gpu_utilization_pct), count(memory_clock_mhz), count(pcie_rx_bytes_per_s), count(pcie_tx_bytes_per_s), count(power_draw_w)]) AS c
             FROM {telemetry}) q""",
    EXTRA,
)
def feature_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = view(spark, sf_dir, "telemetry").select(
        F.col("run_id").cast("string").alias("run_id"),
        F.lit(60.0).alias("window_seconds"),
        "gpu_utilization_pct",
        "power_draw_w",
        "memory_clock_mhz",
        "pcie_tx_bytes_per_s",
        "pcie_rx_bytes_per_s",
        F.lit(1.0).alias("communication_idle_threshold_bytes_per_s"),
    )
    return column_roles(frame, numeric_candidates(frame))


@query(
    "run_level_means",
    "A-19 W-05",
    f"""SELECT run_id, window_seconds, count(*) AS window_count, {r_sql("avg(idle_r)")} AS utilization_idle_fraction, {r_sql("avg(total_r)")} AS pcie_total_mean_bytes_per_s
        FROM (SELECT run_id, window_seconds, {r_sql("idle_fraction")} AS idle_r, {r_sql("total_mean")} AS total_r FROM {{device}}) d GROUP BY run_id, window_seconds""",
    WINDOW_EXTRA,
)
def run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = window_device_summary(spark, sf_dir)
    return round_doubles(
        run_level_means(frame, ("utilization_idle_fraction", "pcie_total_mean_bytes_per_s"))
    )


@query(
    "protocol_sample_digest",
    "P-11",
    """SELECT run_id, count(*) AS samples, count(*) FILTER (WHERE power_draw_w IS NULL) AS unsupported_power, min(mono_ns) AS first_ns, max(sequence) AS last_sequence
       FROM {telemetry} GROUP BY run_id""",
    EXTRA,
)
def protocol_sample_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protocol_samples(view(spark, sf_dir, "telemetry"), "cfg")
    s = F.col("sample")
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~s["telemetry_support_flags"]["power_draw_w"]).alias("unsupported_power"),
        F.min(s["monotonic_ns"]).alias("first_ns"),
        F.max(s["sequence_number"]).alias("last_sequence"),
    )


# --- phases, participation, diagnostics ---------------------------------------
EXTRA["phases"] = """
SELECT run_id, CASE WHEN idle THEN s ELSE f END AS ps, CASE WHEN idle THEN e ELSE l END AS pe
FROM (SELECT *, f IS NULL AND l IS NULL AND coalesce(s <= e, false) AS idle
      FROM (SELECT run_id, min(mono_ns) FILTER (WHERE event = 'collective_start') AS f, max(mono_ns) FILTER (WHERE event = 'collective_complete') AS l,
                   max(interval_start_ns) FILTER (WHERE event = 'measurement_interval') AS s, min(interval_end_ns) FILTER (WHERE event = 'measurement_interval') AS e
            FROM {rank_events} GROUP BY run_id) a) b
"""


@query("phase_intervals", "J-03 S-17", "SELECT run_id, ps AS phase_start_ns, pe AS phase_end_ns FROM {phases}", EXTRA)
def phase_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.phase_intervals(view(spark, sf_dir, "rank_events"))


@query(
    "phase_observations",
    "J-03 A-20",
    f"""SELECT t.run_id, count(total) AS sample_count, {r_sql("avg(total)")} AS mean_bytes_per_s, {r_sql("median(total)")} AS median_bytes_per_s,
               count(*) = count(total) AND count(total) > 0 AS supported, bool_or(ps IS NOT NULL AND pe IS NOT NULL) AS phase_bounded
        FROM (SELECT *, pcie_tx_bytes_per_s + pcie_rx_bytes_per_s AS total FROM {{telemetry}}) t LEFT JOIN {{phases}} p ON p.run_id = t.run_id
        WHERE ps IS NULL OR pe IS NULL OR mono_ns BETWEEN ps AND pe GROUP BY t.run_id""",
    EXTRA,
)
def phase_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = E.phase_intervals(view(spark, sf_dir, "rank_events"))
    return round_doubles(E.phase_observations(view(spark, sf_dir, "telemetry"), phases))


@query(
    "measurement_intervals",
    "J-16",
    """SELECT run_id, CASE WHEN count(DISTINCT rank) = 2 THEN max(interval_start_ns) END AS start_ns, CASE WHEN count(DISTINCT rank) = 2 THEN min(interval_end_ns) END AS end_ns
       FROM {rank_events} WHERE event = 'measurement_interval' GROUP BY run_id""",
    EXTRA,
)
def measurement_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.measurement_intervals(view(spark, sf_dir, "rank_events"))


_REQ = sorted({*E.BASE_EVENTS, *E.MODE_EVENTS["calibration"]})
EXTRA["audit"] = f"""
SELECT run_id, rank, concat_ws(',', {", ".join(f"CASE WHEN count(*) FILTER (WHERE event = '{e}') = 0 THEN '{e}' END" for e in _REQ)}) AS missing_events,
       min(gpu_uuid) FILTER (WHERE event = 'startup') AS gpu_uuid, CASE WHEN count(*) FILTER (WHERE event = 'completion') = 0 THEN 1 ELSE 0 END AS exit_code
FROM {{rank_events}} GROUP BY run_id, rank
"""


@query("participation_by_rank", "A-40 X-01", "SELECT * FROM {audit}", EXTRA)
def participation_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.participation(view(spark, sf_dir, "rank_events"), "calibration")


@query(
    "participation_by_run",
    "A-40 X-03",
    """SELECT run_id, count(*) AS ranks, count(*) FILTER (WHERE missing_events <> '' OR gpu_uuid IS NULL) AS incomplete_ranks, count(DISTINCT gpu_uuid) AS devices,
              max(exit_code) AS exit_code, count(*) = 2 AND count(*) FILTER (WHERE missing_events <> '' OR gpu_uuid IS NULL) = 0 AND count(DISTINCT gpu_uuid) = 2 AS participation_valid
       FROM {audit} GROUP BY run_id""",
    EXTRA,
)
def participation_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.participation_summary(participation_by_rank(spark, sf_dir))


# The audit in SQL: counts per rank and name, no lists.
_NAMES = sorted({*E.BASE_EVENTS, *(e for own in E.MODE_EVENTS.values() for e in own), "strategy_summary"})
_ASKED = {
    **{e: "true" for e in E.BASE_EVENTS},
    "measurement_interval": "mode <> 'smoke'",
    "model_ready": "mode IN ('ddp_train', 'sparse_sync_training')",
    "forward_complete": "mode IN ('ddp_train', 'sparse_sync_training')",
    "backward_complete": "mode IN ('ddp_train', 'sparse_sync_training')",
    "gradient_sync_complete": "mode = 'ddp_train'",
    "optimizer_step_complete": "mode = 'ddp_train'",
    "memory_peak": "mode IN ('ddp_train', 'sparse_sync_training', 'synthetic_communication_decoy')",
    "collective_complete": "mode = 'calibration'",
    "measurement_start": "mode = 'idle'",
    "measurement_end": "mode = 'idle'",
    "process_group_destroyed": "mode = 'idle'",
    "parameter_average_complete": "mode = 'sparse_sync_training'",
    "decoy_burst_complete": "mode = 'synthetic_communication_decoy'",
    "strategy_summary": "designation = 'adversarial'",
}


def _audit_rank(r: int) -> str:
    absent = ", ".join(f"CASE WHEN {_ASKED[e]} AND coalesce(n{r}_{e}, 0) = 0 THEN '{e}' END" for e in _NAMES)
    interval = f"s{r} IS NULL OR e{r} IS NULL OR d{r} IS NULL OR e{r} < s{r} OR d{r} < 0 OR abs(d{r} - (e{r} - s{r}) / CAST(1000000000 AS DOUBLE)) > 0.000001"
    return f"""CASE WHEN concat_ws('+', {absent}) <> '' THEN concat('rank_{r}_missing:', concat_ws('+', {absent})) END,
      CASE WHEN coalesce(n{r}_startup, 0) = 0 THEN 'rank_{r}_without_identity' END,
      CASE WHEN n{r}_measurement_interval > 0 AND ({interval}) THEN 'rank_{r}_invalid_interval' END"""


def _audit_facts(r: int) -> str:
    counts = [f"count(*) FILTER (WHERE rank = {r} AND event = '{e}') AS n{r}_{e}" for e in (*_NAMES, "failure")]
    first = {"k": "startup_rank", "l": "local_rank", "g": "gpu_index", "u": "gpu_uuid", "w": "world_size", "b": "backend"}
    values = [f"arg_min_null({c}, mono_ns) FILTER (WHERE rank = {r} AND event = 'startup') AS {n}{r}" for n, c in first.items()]
    last = {"s": "interval_start_ns", "e": "interval_end_ns", "d": "measured_duration_seconds"}
    values += [f"arg_min_null({c}, mono_ns) FILTER (WHERE rank = {r} AND event = 'measurement_interval') AS {n}{r}" for n, c in last.items()]
    return ", ".join(counts + values)


def _swapped(n: str) -> str:
    return f"CASE WHEN n0_startup > 0 AND n1_startup > 0 AND NOT coalesce({n}0 + {n}1 = 1 AND {n}0 * {n}1 = 0 AND {n}0 IN (0, 1), false)"


EXTRA["run_audit"] = f"""
SELECT run_id, mode, designation, concat_ws(',', {_audit_rank(0)}, {_audit_rank(1)},
    {_swapped("k")} THEN 'ranks_not_zero_and_one' END, {_swapped("l")} THEN 'local_ranks_not_zero_and_one' END, {_swapped("g")} THEN 'devices_not_zero_and_one' END,
    CASE WHEN n0_startup > 0 AND n1_startup > 0 AND u0 IS NOT DISTINCT FROM u1 THEN 'device_uuids_not_distinct' END,
    CASE WHEN n0_startup > 0 AND n1_startup > 0 AND (w0 IS DISTINCT FROM 2 OR w1 IS DISTINCT FROM 2) THEN 'world_size_not_two' END,
    CASE WHEN n0_startup > 0 AND n1_startup > 0 AND (b0 IS DISTINCT FROM 'nccl' OR b1 IS DISTINCT FROM 'nccl') THEN 'backend_not_nccl' END) AS problems,
  CASE WHEN coalesce(n0_failure, 0) > 0 OR coalesce(n0_completion, 0) = 0 THEN 1 ELSE 0 END AS rank_0_exit,
  CASE WHEN coalesce(n1_failure, 0) > 0 OR coalesce(n1_completion, 0) = 0 THEN 1 ELSE 0 END AS rank_1_exit
FROM {{audit_runs}} r LEFT JOIN (SELECT run_id, {_audit_facts(0)}, {_audit_facts(1)} FROM {{audit_events}} GROUP BY run_id) f USING (run_id)
"""


@query("participation_audit", "A-40 X-01 X-03", "SELECT *, problems = '' AS participation_valid FROM {run_audit}", EXTRA)
def participation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.participation_audit(view(spark, sf_dir, "audit_runs"), view(spark, sf_dir, "audit_events"))
    return found.withColumn("problems", F.array_join("problems", ","))


@query(
    "collector_diagnostics",
    "A-38 W-02",
    f"""SELECT run_id, gpu_index, count(*) AS sample_cycles, {r_sql("avg(gap)")} AS mean_interval_s, {r_sql("(CASE WHEN count(gap) > 1 THEN stddev_pop(gap) END)")} AS interval_std_s,
               {r_sql("max(abs(gap - 4))")} AS max_abs_jitter_s, count(*) FILTER (WHERE gap > 4) AS overrun_count,
               {", ".join(f"{r_sql(f'avg(CASE WHEN {f} IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END)')} AS missing_{f}" for f in TELEMETRY_FIELDS)}
        FROM (SELECT *, (mono_ns - lag(mono_ns) OVER (PARTITION BY run_id, gpu_index ORDER BY mono_ns)) / CAST(1000000000 AS DOUBLE) AS gap FROM {{telemetry}}) q
        GROUP BY run_id, gpu_index""",
    EXTRA,
)
def collector_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(E.collector_diagnostics(view(spark, sf_dir, "telemetry"), 4.0))


@query(
    "interval_comparison",
    "A-39",
    f"""SELECT local_steps, count(*) AS repeats, {r_sql("median(wall_seconds)")} AS median, {r_sql("max(b)")} AS baseline_median,
               {r_sql("(median(wall_seconds) / max(b) - 1)")} AS slowdown_fraction
        FROM {{manifests}}, (SELECT median(wall_seconds) AS b FROM {{manifests}} WHERE workload_family = 'control_idle') z
        WHERE workload_family <> 'control_idle' GROUP BY local_steps""",
    EXTRA,
)
def interval_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "manifests")
    return round_doubles(
        E.interval_comparison(rows, "local_steps", "wall_seconds", F.col("workload_family") == "control_idle")
    )


# --- costs, trade-offs, reports -----------------------------------------------
@query(
    "efficiency_cost",
    "A-60 T-06 S-08",
    f"""SELECT workload_family, n AS completed_run_count, {r_sql("m")} AS median_wall_duration_s, {r_sql("b")} AS baseline_median, {r_sql("(m / b)")} AS duration_ratio_vs_baseline
        FROM (SELECT workload_family, count(*) AS n, median(wall_seconds) AS m, arg_max(designation, path) AS d FROM {{manifests}} WHERE exit_status = 'completed' GROUP BY workload_family) f,
             (SELECT median(wall_seconds) AS b FROM {{manifests}} WHERE exit_status = 'completed' AND workload_family = 'ddp_training') z
        WHERE d = 'adversarial'""",
    EXTRA,
)
def efficiency_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(E.efficiency(view(spark, sf_dir, "manifests")))


@query(
    "efficiency_proxies",
    "A-60 F-11",
    f"""WITH m AS (SELECT workload_family, CAST(substr(run_id, 5) AS BIGINT) AS k FROM {{manifests}} WHERE exit_status = 'completed' AND designation = 'adversarial'),
        l AS (SELECT workload_family, 'sync_rounds_per_rank' AS proxy, CAST(k % 100 AS DOUBLE) AS v FROM m UNION ALL
              SELECT workload_family, 'sync_rounds_per_rank', k % 100 + CASE WHEN k % 461 = 18 THEN 2 ELSE 0 END FROM m UNION ALL
              SELECT workload_family, 'communication_bytes_proxy_per_rank', k % 5000 FROM m UNION ALL SELECT workload_family, 'communication_bytes_proxy_per_rank', k % 4000 FROM m UNION ALL
              SELECT workload_family, 'final_loss_proxy_per_rank', CASE WHEN k % 457 = 17 THEN NULL ELSE k % 7 END FROM m UNION ALL SELECT workload_family, 'final_loss_proxy_per_rank', k % 11 FROM m UNION ALL
              SELECT workload_family, 'peak_allocated_bytes_per_rank', k % 900 FROM m UNION ALL SELECT workload_family, 'peak_allocated_bytes_per_rank', k % 800 FROM m)
        SELECT workload_family, proxy, count(v) AS n, {r_sql("median(v)")} AS median FROM l GROUP BY workload_family, proxy""",
    EXTRA,
)
def efficiency_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(E.proxy_medians(view(spark, sf_dir, "manifests")))


@query(
    "utility_tradeoff",
    "A-64 J-12 J-13 F-05",
    f"""WITH j AS (SELECT m.run_id, m.plan_id AS workload_config_id, m.local_steps, s.detector_score, CAST(m.sync_rounds AS DOUBLE) AS sync_rounds, m.wall_seconds
                   FROM {{manifests}} m LEFT JOIN (SELECT concat('plan-', CAST(c_custkey AS VARCHAR)) AS workload_config_id, c_acctbal AS detector_score FROM {{customer}} WHERE c_acctbal > 0) s
                   ON s.workload_config_id = m.plan_id),
             b AS (SELECT * FROM j WHERE local_steps = 1 ORDER BY run_id LIMIT 1)
        SELECT j.run_id, j.workload_config_id, j.local_steps, {r_sql("j.detector_score")} AS detector_score, {r_sql("j.sync_rounds")} AS sync_rounds, {r_sql("j.wall_seconds")} AS wall_seconds,
               {r_sql("(1 - j.sync_rounds / nullif(b.sync_rounds, 0))")} AS sync_rounds_reduction, {r_sql("(1 - j.wall_seconds / nullif(b.wall_seconds, 0))")} AS wall_seconds_reduction
        FROM j, b""",
    EXTRA,
)
def utility_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = view(spark, sf_dir, "manifests")
    runs = manifests.select("run_id", F.col("plan_id").alias("workload_config_id"), "local_steps")
    features = manifests.select("run_id", F.col("sync_rounds").cast("double").alias("sync_rounds"), "wall_seconds")
    scores = base_table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("plan-"), F.col("c_custkey").cast("string")).alias("workload_config_id"),
        F.col("c_acctbal").alias("detector_score"),
    )
    return round_doubles(E.tradeoff(runs, scores, features, ("sync_rounds", "wall_seconds")))


@query(
    "calibration_references",
    "J-09 P-26",
    """SELECT o_orderkey AS reference_id, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'missing_artifact' END,
              CASE WHEN o_orderkey % 101 = 1 THEN 'sha256_mismatch' END, CASE WHEN o_orderkey % 103 = 2 THEN 'session_mismatch' END,
              CASE WHEN c_acctbal <= 0 THEN 'status_mismatch' END, CASE WHEN c_acctbal <= 0 THEN 'not_supported' END,
              CASE WHEN o_orderkey % 107 = 3 THEN 'relationship_conflict' END) AS problems
       FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey""",
    EXTRA,
)
def calibration_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("o_orderkey")
    calibrations = base_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("results/calibration-"), c("c_custkey").cast("string")).alias("path"),
        F.sha2(c("c_name"), 256).alias("sha256"),
        c("c_mktsegment").alias("session"),
        F.when(c("c_acctbal") > 0, "supported").otherwise("not_supported").alias("status"),
    )
    owners = base_table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    references = base_table(spark, sf_dir, "orders").join(owners, "o_custkey", "left").select(
        k.alias("reference_id"),
        F.concat(F.lit("results/calibration-"), c("o_custkey").cast("string")).alias("calibration_path"),
        F.when(k % 101 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(c("c_name"), 256)).alias("sha256"),
        F.when(k % 103 == 2, "other").otherwise(c("c_mktsegment")).alias("session"),
        F.lit("supported").alias("status"),
        F.lit("current_session").alias("relationship"),
        (k % 107 != 3).alias("created_in_session"),
    )
    return E.verify_references(references, calibrations, ("session", "status"))


@query(
    "study_checks",
    "A-44",
    """SELECT sweep_id, count(*) AS observations, count(*) FILTER (WHERE exit_status IS DISTINCT FROM 'completed') AS failed,
              count(*) FILTER (WHERE coalesce(measured_duration_seconds, 0) < 28.5) AS short,
              count(*) FILTER (WHERE coalesce(measured_duration_seconds / mean_interval_s, 0) < 25) AS sparse
       FROM {observations} GROUP BY sweep_id""",
    EXTRA,
)
def study_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.study_checks(view(spark, sf_dir, "observations"), 30.0, 25)


@query(
    "run_report",
    "A-42",
    f"""SELECT workload_family, exit_status, count(*) AS runs, count(*) FILTER (WHERE participation_valid) AS valid_runs, {r_sql("avg(wall_seconds)")} AS mean_wall_seconds
        FROM {{manifests}} GROUP BY workload_family, exit_status""",
    EXTRA,
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(E.run_report(view(spark, sf_dir, "manifests")))


@query(
    "newest_manifest_per_plan",
    "T-02 T-06 S-09",
    "SELECT plan_id, arg_max(run_id, path) AS run_id, max(path) AS path FROM {manifests} GROUP BY plan_id",
    EXTRA,
)
def newest_manifest_per_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "manifests").groupBy("plan_id").agg(
        F.max_by("run_id", "path").alias("run_id"), F.max("path").alias("path")
    )


# --- plans ----------------------------------------------------------------------
@query(
    "matrix_plan",
    "G-01 W-07 W-08",
    """SELECT profile, workload_name, entry_id, pos AS plan_index, occ AS occurrence, printf('%s-%04d-%s-%03d', profile, pos, workload_name, occ) AS plan_id
       FROM (SELECT *, row_number() OVER (PARTITION BY profile, workload_name, entry_id ORDER BY pos) - 1 AS occ
             FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY sha256(concat('20260730:', profile, ':', workload_name, ':', CAST(entry_id AS VARCHAR), ':', CAST(slot AS VARCHAR)))) - 1 AS pos
                   FROM {workloads}, (VALUES (0), (1), (2)) s(slot)) a) b""",
    EXTRA,
)
def matrix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.matrix_plan(view(spark, sf_dir, "workloads"), 3)


@query(
    "matrix_estimate",
    "A-36",
    f"""SELECT profile, count(*) * 3 AS run_count, {r_sql("(sum(estimated_seconds) * 3 * 2 / 60)")} AS estimated_gpu_minutes,
               {r_sql("greatest(5, sum(estimated_seconds) * 3 * CAST(0.02 AS DOUBLE))")} AS estimated_artifact_mib FROM {{workloads}} GROUP BY profile""",
    EXTRA,
)
def matrix_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(P.matrix_estimate(view(spark, sf_dir, "workloads"), 3))


EXTRA["rounds"] = """
SELECT *, CASE WHEN strategy_id = 'synthetic_communication_decoy' OR experiment_session_id = 'session-11' OR coalesce(config_id IN ('config-2', 'config-18'), false) THEN 'sealed_final_holdout'
               WHEN strategy_id IN ('randomized_synchronization', 'mixed_training_inference') THEN 'hardening'
               WHEN strategy_id IN ('gradient_accumulation', 'periodic_local_sgd', 'diloco_inspired', 'segmented_runs', 'idle_padding') THEN 'development' END AS round
FROM {workloads}
"""


@query("holdout_rounds", "P-20", "SELECT entry_id, strategy_id, round FROM {rounds}", EXTRA)
def holdout_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    round_name = HOLDOUT.round_of(c("strategy_id"), c("experiment_session_id"), c("config_id"))
    return view(spark, sf_dir, "workloads").select("entry_id", "strategy_id", round_name.alias("round"))


@query(
    "adversarial_plan",
    "G-02",
    """SELECT entry_id, round, r.rep AS repetition, s.slot, printf('adversarial-%s-r%03d-s%03d', strategy_id, r.rep, s.slot) AS plan_id
       FROM {rounds} w, (VALUES (0), (1)) r(rep), (SELECT unnest(generate_series(0, 7)) AS slot) s
       WHERE round IS NOT NULL AND s.slot < CASE WHEN strategy_id = 'segmented_runs' AND round <> 'sealed_final_holdout' THEN segment_count ELSE 1 END""",
    EXTRA,
)
def adversarial_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.adversarial_plan(view(spark, sf_dir, "workloads"), HOLDOUT, 2)


@query(
    "sealed_counts",
    "A-37",
    """SELECT strategy_id, count(*) AS planned, count(*) FILTER (WHERE round = 'sealed_final_holdout') AS sealed, count(*) FILTER (WHERE steps > 10) AS completed,
              count(*) FILTER (WHERE steps <= 10 AND round IS DISTINCT FROM 'sealed_final_holdout') AS failed FROM {rounds} WHERE round IS NOT NULL GROUP BY strategy_id""",
    EXTRA,
)
def sealed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    plans = view(spark, sf_dir, "workloads").select(
        "strategy_id",
        HOLDOUT.round_of(c("strategy_id"), c("experiment_session_id"), c("config_id")).alias("round"),
        F.when(c("steps") > 10, c("entry_id")).alias("accepted_run_id"),
    )
    return P.sealed_counts(plans.where("round IS NOT NULL"))


_BOUNDS = ", ".join(f"('{a}', '{b}', {lo}, {hi}, {str(w).lower()})" for a, b, lo, hi, w in P.STRATEGY_BOUNDS)


@query(
    "strategy_bounds",
    "P-21",
    f"""SELECT entry_id, strategy_id, parameter, CASE WHEN strategy_id = 'unlisted' THEN 'unknown_strategy' WHEN b.lo IS NULL THEN 'unknown_parameter'
               WHEN parameter_value < b.lo OR parameter_value > b.hi THEN 'out_of_bounds' WHEN b.whole AND parameter_value <> floor(parameter_value) THEN 'not_integral' END AS problem
        FROM {{workloads}} LEFT JOIN (VALUES {_BOUNDS}) b(strategy_id, parameter, lo, hi, whole) USING (strategy_id, parameter)""",
    EXTRA,
)
def strategy_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bound_problems(view(spark, sf_dir, "workloads")).select("entry_id", "strategy_id", "parameter", "problem")


@query(
    "workload_names",
    "P-22",
    r"""SELECT entry_id, CASE WHEN regexp_matches(workload_name, '^collective_(all_reduce|broadcast|all_gather|reduce_scatter|send_recv)_([1-9][0-9]*)mib$') THEN 'calibration'
               WHEN regexp_matches(workload_name, '^adversarial_periodic_local_sgd_k(1|2|4|8|16)$') THEN 'periodic_local_sgd'
               WHEN starts_with(workload_name, 'collective_') OR starts_with(workload_name, 'adversarial_') THEN 'unknown' ELSE 'registered' END AS kind,
               nullif(regexp_extract(workload_name, '^collective_(all_reduce|broadcast|all_gather|reduce_scatter|send_recv)_([1-9][0-9]*)mib$', 1), '') AS collective,
               CAST(nullif(regexp_extract(workload_name, '^collective_(all_reduce|broadcast|all_gather|reduce_scatter|send_recv)_([1-9][0-9]*)mib$', 2), '') AS BIGINT) AS payload_mib,
               CAST(nullif(regexp_extract(workload_name, '^adversarial_periodic_local_sgd_k(1|2|4|8|16)$', 1), '') AS BIGINT) AS local_steps
        FROM {workloads}""",
    EXTRA,
)
def workload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "workloads").select("entry_id", *P.parse_workload_name(F.col("workload_name")))


@query(
    "registry_problems",
    "G-03",
    """SELECT entry_id, concat_ws(',', CASE WHEN config_id IS NULL THEN 'missing_config_id' END,
              CASE WHEN config_id IS NOT NULL AND count(*) OVER (PARTITION BY config_id) > 1 THEN 'shared_config_id' END,
              CASE WHEN designation = 'benign' AND warmup_seconds < 0 THEN 'negative_warmup' END,
              CASE WHEN min_measured_seconds < 35 THEN 'measured_too_short' END,
              CASE WHEN estimated_seconds < warmup_seconds + min_measured_seconds THEN 'estimate_too_short' END,
              CASE WHEN designation = 'benign' AND batch_size > 4 THEN 'batch_size_above_bound' END) AS problems FROM {workloads}""",
    EXTRA,
)
def registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.registry_problems(view(spark, sf_dir, "workloads"))


@query(
    "sync_schedule",
    "P-27",
    """SELECT entry_id, step, step = steps OR CASE WHEN strategy_id = 'randomized_synchronization'
              THEN CAST(concat('0x', substr(sha256(concat('20260730:', CAST(entry_id AS VARCHAR), ':', CAST(step AS VARCHAR))), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE) < parameter_value
              ELSE step % greatest(1, CAST(floor(parameter_value) AS BIGINT)) = 0 END AS synchronize
       FROM (SELECT *, unnest(generate_series(1, steps)) AS step FROM {workloads}) w""",
    EXTRA,
)
def sync_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    random = F.col("strategy_id") == "randomized_synchronization"
    configs = view(spark, sf_dir, "workloads").select(
        "entry_id",
        "steps",
        F.when(~random, F.greatest(F.lit(1), F.floor("parameter_value"))).alias("every"),
        F.when(random, F.col("parameter_value")).alias("probability"),
    )
    return P.sync_schedule(configs)


@query(
    "resume_status",
    "J-07",
    """SELECT plan_id, attempts, status, CASE WHEN status = 'accepted' THEN candidate END AS accepted_run_id
       FROM (SELECT *, CASE WHEN mismatches > 0 THEN 'mismatched_attempt' WHEN accepted > 1 THEN 'duplicate_accepted' WHEN accepted = 1 THEN 'accepted' ELSE 'pending' END AS status
             FROM (SELECT p.plan_id, count(m.run_id) AS attempts, count(*) FILTER (WHERE m.planned_hash <> p.planned_hash) AS mismatches,
                          count(*) FILTER (WHERE m.exit_status = 'completed' AND m.participation_valid AND m.measured_duration_seconds >= 30) AS accepted,
                          min(m.run_id) FILTER (WHERE m.exit_status = 'completed' AND m.participation_valid AND m.measured_duration_seconds >= 30) AS candidate
                   FROM (SELECT concat('plan-', CAST(c_custkey AS VARCHAR)) AS plan_id, concat('h-', CAST(c_custkey AS VARCHAR)) AS planned_hash FROM {customer}) p
                   LEFT JOIN {manifests} m USING (plan_id) GROUP BY p.plan_id) a) b""",
    EXTRA,
)
def resume_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    plans = base_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("plan-"), key).alias("plan_id"), F.concat(F.lit("h-"), key).alias("planned_hash")
    )
    attempts = view(spark, sf_dir, "manifests").select(
        "plan_id", "run_id", "planned_hash", "exit_status", "participation_valid", "measured_duration_seconds"
    )
    return P.resume_status(plans, attempts)


EXTRA["cells"] = """
SELECT sweep_id, repetition, kind, payload FROM (SELECT DISTINCT sweep_id FROM {observations}) s, (SELECT unnest(generate_series(0, 4)) AS repetition) r,
  (VALUES ('idle_baseline', CAST(0 AS DOUBLE)), ('collective', CAST(1 AS DOUBLE)), ('collective', CAST(4 AS DOUBLE)), ('collective', CAST(16 AS DOUBLE)), ('collective', CAST(64 AS DOUBLE)), ('collective', CAST(128 AS DOUBLE))) c(kind, payload)
"""


@query("calibration_expected_matrix", "G-05", f"SELECT sweep_id, repetition, kind, {r_sql('payload')} AS payload FROM {{cells}}", EXTRA)
def calibration_expected_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweeps = view(spark, sf_dir, "observations").select("sweep_id").distinct()
    return round_doubles(P.expected_calibration_matrix(sweeps))


@query(
    "calibration_matrix_diff",
    "J-10 X-03",
    f"""SELECT sweep_id, repetition, kind, {r_sql("payload")} AS payload, coalesce(n, 0) AS observations,
               CASE WHEN n IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem
        FROM (SELECT *, true AS wanted FROM {{cells}}) e FULL OUTER JOIN
             (SELECT sweep_id, repetition, coalesce(observation_type, CASE WHEN is_idle THEN 'idle_baseline' ELSE 'collective' END) AS kind, payload_mib AS payload, count(*) AS n
              FROM {{observations}} GROUP BY ALL) o USING (sweep_id, repetition, kind, payload)
        WHERE n IS NULL OR wanted IS NULL OR n > 1""",
    EXTRA,
)
def calibration_matrix_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "observations")
    observed = rows.select(
        "sweep_id",
        "repetition",
        F.coalesce(
            "observation_type", F.when(F.col("is_idle"), "idle_baseline").otherwise("collective")
        ).alias("kind"),
        F.col("payload_mib").alias("payload"),
    )
    expected = P.expected_calibration_matrix(rows.select("sweep_id").distinct())
    return round_doubles(P.calibration_matrix_diff(expected, observed))


# --- text evidence ----------------------------------------------------------------
@query(
    "evidence_lines",
    "S-01 S-08",
    """SELECT CASE WHEN o_orderkey % 17 = 3 THEN 'blank' WHEN o_orderkey % 19 = 4 THEN 'corrupt' ELSE 'ok' END AS state, o_orderpriority AS source, count(*) AS lines,
              CAST(sum(CASE WHEN o_orderkey % 17 <> 3 AND o_orderkey % 19 <> 4 THEN o_custkey END) AS BIGINT) AS rank_sum
       FROM {orders} GROUP BY 1, 2""",
    EXTRA,
)
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.sources.evidence import parse_lines

    k = F.col("o_orderkey")
    text = F.format_string('{"run_id":"run-%d","rank":%d}', k, F.col("o_custkey"))
    lines = base_table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"),
        F.when(k % 17 == 3, "  ").when(k % 19 == 4, F.substring(text, 1, 12)).otherwise(text).alias("line"),
    )
    parsed = parse_lines(lines, "line", "run_id string, rank bigint")
    return parsed.groupBy("state", "source").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("record.rank").alias("rank_sum")
    )
