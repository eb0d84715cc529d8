"""Coverage records, gates and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.registry import query, r_sql, round_doubles
from gaugeworks.catalog.window_queries import EXTRA as WINDOW_EXTRA
from gaugeworks.catalog.window_queries import LENGTHS, TOLERANCE
from gaugeworks.operators import coverage as V
from gaugeworks.operators import window_batches as B
from gaugeworks.operators import windows as W
from gaugeworks.operators.alignment import pair_counts
from gaugeworks.schemas import COVERAGE_REASONS
from gaugeworks.sources.views import view

REQUIRED_FAMILIES = (
    "control_compute",
    "control_host_transfer",
    "control_idle",
    "control_model_or_checkpoint_load",
    "ddp_training",
    "inference_decode_independent",
    "inference_prefill_independent",
    "inference_synchronized",
    "peer_copy",
)
PRIMARY = 360.0

EXTRA = dict(WINDOW_EXTRA)
EXTRA["gated"] = """
SELECT p.*, m.warmup_seconds, m.measurement_start_ns, m.measurement_end_ns,
       CASE WHEN p.accepted_run_id IS NULL THEN 'incomplete_run'
            WHEN p.designation = 'calibration' THEN 'calibration_run_excluded'
            WHEN p.designation <> 'benign' THEN 'not_in_selected_corpus'
            WHEN m.run_id IS NULL THEN 'incomplete_run'
            WHEN m.corpus_id <> p.corpus_id THEN 'not_in_selected_corpus'
            WHEN m.exit_status <> 'completed' THEN 'incomplete_run'
            WHEN NOT m.participation_valid THEN 'participation_invalid'
            WHEN m.workload_family <> p.workload_family OR m.target_label <> p.target_label THEN 'invalid_manifest' END AS manifest_reason
FROM {planned_runs} p LEFT JOIN {runs} m ON m.run_id = p.accepted_run_id
"""
EXTRA["facts"] = """
SELECT run_id, count(*) FILTER (WHERE gpu_index = 0) AS rows_gpu0, count(*) FILTER (WHERE gpu_index = 1) AS rows_gpu1,
       greatest(min(mono_ns) FILTER (WHERE gpu_index = 0), min(mono_ns) FILTER (WHERE gpu_index = 1)) AS cs,
       least(max(mono_ns) FILTER (WHERE gpu_index = 0), max(mono_ns) FILTER (WHERE gpu_index = 1)) AS ce,
       count(*) FILTER (WHERE schema_version NOT IN ('1.0', '2.0')) AS bad_versions
FROM {telemetry} GROUP BY run_id
"""
EXTRA["interval"] = """
SELECT g.plan_id, g.accepted_run_id AS run_id, g.workload_family, g.target_label, g.designation, g.corpus_id, g.workload_config_id,
       g.manifest_reason, f.rows_gpu0, f.rows_gpu1, f.cs, f.ce, f.bad_versions,
       CASE WHEN f.rows_gpu1 > 0 AND f.rows_gpu0 > 0 THEN
         CASE WHEN g.measurement_start_ns IS NOT NULL THEN greatest(f.cs, g.measurement_start_ns)
              ELSE f.cs + CAST(g.warmup_seconds * 1000000000 AS BIGINT) END END AS us,
       CASE WHEN f.rows_gpu1 > 0 AND f.rows_gpu0 > 0 THEN least(f.ce, coalesce(g.measurement_end_ns, f.ce)) END AS ue
FROM {gated} g LEFT JOIN {facts} f ON f.run_id = g.accepted_run_id AND g.manifest_reason IS NULL
"""
EXTRA["run_clocks"] = """
SELECT t.run_id, list(t.mono_ns ORDER BY t.mono_ns) FILTER (WHERE t.gpu_index = 0) AS l,
       list(t.mono_ns ORDER BY t.mono_ns) FILTER (WHERE t.gpu_index = 1) AS r
FROM {telemetry} t JOIN {interval} i ON i.run_id = t.run_id AND t.mono_ns BETWEEN i.us AND i.ue
WHERE i.manifest_reason IS NULL AND i.bad_versions = 0 AND i.ue - i.us >= 60000000000
GROUP BY t.run_id
"""
EXTRA["run_scan"] = """
SELECT run_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, l[1] - r[1] AS delta FROM {run_clocks}
UNION ALL
SELECT run_id, ni, nj, l[ni] - r[nj] FROM (
  SELECT s.run_id, c.l, c.r,
         CASE WHEN abs(s.delta) <= 2000000000 OR s.delta < 0 THEN s.i + 1 ELSE s.i END AS ni,
         CASE WHEN abs(s.delta) <= 2000000000 OR s.delta > 0 THEN s.j + 1 ELSE s.j END AS nj
  FROM run_scan s JOIN {run_clocks} c USING (run_id)) t
WHERE ni <= len(l) AND nj <= len(r)
"""
EXTRA["run_pairs"] = """
SELECT run_id, count(*) AS aligned FROM {run_scan} WHERE abs(delta) <= 2000000000 GROUP BY run_id
"""
EXTRA["emitted"] = """
SELECT run_id, count(*) FILTER (WHERE window_seconds = 60) AS e60, count(*) FILTER (WHERE window_seconds = 180) AS e180,
       count(*) FILTER (WHERE window_seconds = 360) AS e360 FROM {kept} GROUP BY run_id
"""
EXTRA["coverage"] = """
SELECT plan_id, run_id, workload_family, target_label, designation, corpus_id,
       CASE WHEN reason_code IS NULL THEN 'included' ELSE 'excluded' END AS status, reason_code,
       CASE WHEN readable THEN coalesce(rows_gpu0, 0) ELSE 0 END AS rows_gpu0, CASE WHEN readable THEN coalesce(rows_gpu1, 0) ELSE 0 END AS rows_gpu1,
       CASE WHEN two THEN cs END AS common_start_ns, CASE WHEN two THEN ce END AS common_end_ns,
       CASE WHEN two AND ce > cs THEN (ce - cs) / CAST(1000000000 AS DOUBLE) ELSE 0 END AS common_overlap_seconds,
       CASE WHEN two AND ce > cs THEN greatest(0, (ue - us) / CAST(1000000000 AS DOUBLE)) ELSE 0 END AS usable_duration_seconds,
       coalesce(aligned, 0) AS aligned_sample_pairs,
       CASE WHEN reason_code IS NULL THEN coalesce(e60, 0) ELSE 0 END AS emitted_60,
       CASE WHEN reason_code IS NULL THEN coalesce(e180, 0) ELSE 0 END AS emitted_180,
       CASE WHEN reason_code IS NULL THEN coalesce(e360, 0) ELSE 0 END AS emitted_360, workload_config_id
FROM (SELECT i.*, p.aligned, e.e60, e.e180, e.e360,
             i.manifest_reason IS NULL AND coalesce(i.bad_versions, 0) = 0 AS readable,
             i.manifest_reason IS NULL AND i.bad_versions = 0 AND i.rows_gpu0 > 0 AND i.rows_gpu1 > 0 AS two,
             CASE WHEN manifest_reason IS NOT NULL THEN manifest_reason
                  WHEN rows_gpu0 IS NULL THEN 'missing_telemetry'
                  WHEN bad_versions > 0 THEN 'unsupported_telemetry_schema'
                  WHEN rows_gpu0 = 0 OR rows_gpu1 = 0 THEN 'missing_required_gpu'
                  WHEN ce <= cs THEN 'no_common_interval'
                  WHEN ue - us < 60000000000 THEN 'post_warmup_interval_too_short'
                  WHEN coalesce(p.aligned, 0) < 2 OR coalesce(e.e60, 0) + coalesce(e.e180, 0) + coalesce(e.e360, 0) = 0 THEN 'insufficient_samples' END AS reason_code
      FROM {interval} i LEFT JOIN {run_pairs} p USING (run_id) LEFT JOIN {emitted} e USING (run_id)) x
"""
REQUIRED_SQL = ", ".join(f"('{f}')" for f in REQUIRED_FAMILIES)
R = "WITH RECURSIVE out AS (SELECT 1)\n"


def kept_windows(telemetry: DataFrame, runs: DataFrame) -> DataFrame:
    return B.kept_windows(W.block_samples(telemetry, W.run_bounds(telemetry, runs), LENGTHS), LENGTHS, TOLERANCE)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.coverage_records(
        view(spark, sf_dir, "planned_runs"),
        view(spark, sf_dir, "runs"),
        view(spark, sf_dir, "telemetry"),
        kept_windows,
        LENGTHS,
        TOLERANCE,
    )


@query(
    "coverage_manifest_gates",
    "J-04 J-05",
    "SELECT plan_id, accepted_run_id, manifest_reason FROM {gated}",
    EXTRA,
)
def manifest_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.manifest_reasons(
        view(spark, sf_dir, "planned_runs"), view(spark, sf_dir, "runs"), ("benign",)
    ).select("plan_id", "accepted_run_id", "manifest_reason")


@query(
    "sampling_gap_stats",
    "A-30 W-02",
    f"""SELECT run_id, gpu_index, count(gap) AS interval_count, {r_sql("min(gap)")} AS minimum, {r_sql("max(gap)")} AS maximum,
               {r_sql("quantile_cont(gap, CAST(0.5 AS DOUBLE))")} AS median, {r_sql("quantile_cont(gap, CAST(0.95 AS DOUBLE))")} AS p95
        FROM (SELECT run_id, gpu_index, (mono_ns - lag(mono_ns) OVER (PARTITION BY run_id, gpu_index ORDER BY mono_ns)) / CAST(1000000000 AS DOUBLE) AS gap
              FROM {{telemetry}}) g
        WHERE gap IS NOT NULL GROUP BY run_id, gpu_index""",
    EXTRA,
)
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(V.sampling_gaps(view(spark, sf_dir, "telemetry")))


@query(
    "run_pair_counts",
    "J-01 A-41",
    "WITH RECURSIVE out AS (SELECT 1)\nSELECT run_id, count(*) AS aligned_sample_pairs FROM {whole_scan} WHERE abs(delta) <= 2000000000 GROUP BY run_id",
    {
        **EXTRA,
        "whole_clocks": """SELECT run_id, list(mono_ns ORDER BY mono_ns) FILTER (WHERE gpu_index = 0) AS l,
               list(mono_ns ORDER BY mono_ns) FILTER (WHERE gpu_index = 1) AS r FROM {telemetry} GROUP BY run_id HAVING count(DISTINCT gpu_index) = 2""",
        "whole_scan": EXTRA["run_scan"].replace("run_scan", "whole_scan").replace("run_clocks", "whole_clocks"),
    },
)
def run_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_counts(view(spark, sf_dir, "telemetry"), TOLERANCE)


@query(
    "coverage_records",
    "A-31 A-41 J-04 P-04",
    R
    + f"""SELECT plan_id, run_id, workload_family, target_label, designation, corpus_id, status, reason_code, rows_gpu0, rows_gpu1,
               common_start_ns, common_end_ns, {r_sql("common_overlap_seconds")} AS common_overlap_seconds,
               {r_sql("usable_duration_seconds")} AS usable_duration_seconds, aligned_sample_pairs, emitted_60, emitted_180, emitted_360
        FROM {{coverage}}""",
    EXTRA,
)
def coverage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(coverage(spark, sf_dir))


@query(
    "extraction_summary",
    "A-32",
    R
    + """SELECT c.corpus_id, count(*) AS planned_run_count, count(*) FILTER (WHERE status = 'included') AS included_run_count,
               count(*) FILTER (WHERE status = 'excluded') AS excluded_run_count,
               CAST(sum(emitted_60 + emitted_180 + emitted_360) AS BIGINT) AS feature_row_count,
               max((SELECT string_agg(reason_code || '=' || n, ',' ORDER BY reason_code || '=' || n)
                    FROM (SELECT reason_code, count(*) AS n FROM {coverage} WHERE reason_code IS NOT NULL GROUP BY reason_code) q)) AS reason_counts
        FROM {coverage} c GROUP BY c.corpus_id""",
    EXTRA,
)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extraction_summary(coverage(spark, sf_dir))


@query(
    "coverage_invariants",
    "A-33",
    R
    + """SELECT plan_id, CASE WHEN usable_duration_seconds > common_overlap_seconds + 0.000000001 THEN 'usable_exceeds_overlap' ELSE '' END AS violations
        FROM {coverage}""",
    EXTRA,
)
def coverage_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.invariant_violations(coverage(spark, sf_dir), COVERAGE_REASONS)


@query(
    "primary_coverage_gate",
    "A-34 J-06 A-41",
    R
    + f"""SELECT f.workload_family, count(c.plan_id) FILTER (WHERE valid) AS valid_runs,
               coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) FROM
                 (SELECT coalesce(reason_code, 'no_common_window_length') AS reason, count(*) AS n FROM {{coverage}} x
                  WHERE x.workload_family = f.workload_family AND NOT (status = 'included' AND emitted_360 > 0) GROUP BY 1) q), '') AS failures,
               count(c.plan_id) FILTER (WHERE valid) >= 3 AS passed
        FROM (VALUES {REQUIRED_SQL}) f(workload_family)
        LEFT JOIN (SELECT *, status = 'included' AND emitted_360 > 0 AS valid FROM {{coverage}}) c USING (workload_family)
        GROUP BY f.workload_family""",
    EXTRA,
)
def primary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([(f,) for f in REQUIRED_FAMILIES], "workload_family string")
    return V.primary_gate(coverage(spark, sf_dir), families, (PRIMARY,), 3)


@query(
    "family_summary",
    "A-35 J-08",
    R
    + """SELECT p.workload_family, count(*) AS planned, count(p.accepted_run_id) AS completed,
               count(*) FILTER (WHERE p.accepted_run_id IS NULL) AS failed,
               count(*) FILTER (WHERE c.status = 'included' AND c.emitted_360 > 0) AS feature_valid,
               count(*) FILTER (WHERE c.status = 'excluded') AS feature_excluded,
               count(DISTINCT coalesce(p.workload_config_id, sha256(p.plan_id))) AS config_count,
               count(DISTINCT c.reason_code) AS reason_kinds
        FROM {planned_runs} p JOIN {coverage} c USING (plan_id) GROUP BY p.workload_family""",
    EXTRA,
)
def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.family_summary(view(spark, sf_dir, "planned_runs"), coverage(spark, sf_dir), PRIMARY)


@query(
    "missing_families",
    "J-06 X-01",
    f"""SELECT f.workload_family, s.experiment_session_id
        FROM (VALUES {REQUIRED_SQL}) f(workload_family), (SELECT DISTINCT experiment_session_id FROM {{runs}}) s
        WHERE NOT EXISTS (SELECT 1 FROM {{runs}} r WHERE r.workload_family = f.workload_family AND r.experiment_session_id = s.experiment_session_id)""",
    EXTRA,
)
def missing_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "runs").select("workload_family", "experiment_session_id")
    wanted = F.explode(F.array(*[F.lit(f) for f in REQUIRED_FAMILIES])).alias("workload_family")
    expected = runs.select("experiment_session_id").distinct().select("experiment_session_id", wanted)
    return expected.join(runs, ["workload_family", "experiment_session_id"], "left_anti").select(
        "workload_family", "experiment_session_id"
    )
