"""Calibration sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.registry import query, r_sql, round_doubles, rounded
from gaugeworks.operators import calibration as C
from gaugeworks.sources.views import view

RULES = C.CalibrationRules(
    minimum_measured_duration_s=30.0, maximum_interval_relative_error=0.1
)

EXTRA: dict[str, str] = {}
EXTRA["prepared"] = """
SELECT *, coalesce(observation_type, CASE WHEN is_idle THEN 'idle_baseline' ELSE 'collective' END) AS kind,
       CASE WHEN payload_mib >= 0 THEN payload_mib END AS payload,
       CASE WHEN pcie_total_mean_bytes_per_s >= 0 THEN pcie_total_mean_bytes_per_s END AS signal,
       pcie_supported AS supported,
       participation_valid AND (exit_status IS NULL OR exit_status = 'completed')
         AND coalesce(measured_duration_seconds >= 30, false)
         AND coalesce(abs(mean_interval_s - requested_interval_s) / requested_interval_s <= CAST(0.1 AS DOUBLE), false) AS usable
FROM {observations}
"""
EXTRA["idle_signals"] = "SELECT * FROM {prepared} WHERE kind = 'idle_baseline' AND supported AND usable AND signal IS NOT NULL"
EXTRA["baseline"] = """
SELECT sweep_id, count(*) AS idle_usable, max(m) AS idle_median, median(abs(signal - m)) AS idle_mad,
       count(*) >= 3 AS idle_complete,
       max(m) + greatest(3 * median(abs(signal - m)), CAST(1000000 AS DOUBLE)) AS capture_threshold
FROM (SELECT *, median(signal) OVER (PARTITION BY sweep_id) AS m FROM {idle_signals}) q GROUP BY sweep_id
"""
EXTRA["signals"] = """
SELECT *, median(signal) OVER (PARTITION BY sweep_id, payload) AS m FROM {prepared}
WHERE kind = 'collective' AND payload IS NOT NULL AND supported AND usable AND signal IS NOT NULL
"""
EXTRA["summaries"] = """
SELECT c.*, s.median_signal, s.mean_signal, s.mad_signal, s.cv, coalesce(s.usable_repetitions, 0) AS usable_repetitions,
       coalesce(s.captured, 0) AS captured,
       coalesce(s.captured / CAST(s.usable_repetitions AS DOUBLE), 0) AS capture_rate,
       coalesce(s.usable_repetitions >= 3 AND s.captured / CAST(s.usable_repetitions AS DOUBLE) >= CAST(0.8 AS DOUBLE), false) AS reliable
FROM (SELECT sweep_id, payload, count(*) AS repetitions,
             count(*) FILTER (WHERE supported AND NOT usable) AS invalid_participation,
             count(*) FILTER (WHERE supported AND usable AND signal IS NULL) AS invalid_signal
      FROM {prepared} WHERE kind = 'collective' AND payload IS NOT NULL GROUP BY sweep_id, payload) c
LEFT JOIN (SELECT g.sweep_id, g.payload, count(*) AS usable_repetitions, max(g.m) AS median_signal, avg(g.signal) AS mean_signal,
                  median(abs(g.signal - g.m)) AS mad_signal,
                  CASE WHEN avg(g.signal) = 0 THEN 0 ELSE stddev_pop(g.signal) / abs(avg(g.signal)) END AS cv,
                  count(*) FILTER (WHERE g.signal > b.capture_threshold) AS captured
           FROM {signals} g LEFT JOIN {baseline} b USING (sweep_id) GROUP BY g.sweep_id, g.payload) s
USING (sweep_id, payload)
"""
EXTRA["ranks"] = """
SELECT sweep_id, payload, median_signal,
       rank() OVER (PARTITION BY sweep_id ORDER BY payload) - 1
         + (count(*) OVER (PARTITION BY sweep_id, payload) - 1) / CAST(2 AS DOUBLE) AS x,
       rank() OVER (PARTITION BY sweep_id ORDER BY median_signal) - 1
         + (count(*) OVER (PARTITION BY sweep_id, median_signal) - 1) / CAST(2 AS DOUBLE) AS y
FROM {summaries} WHERE median_signal IS NOT NULL
"""
EXTRA["spearman"] = """
SELECT sweep_id, CASE WHEN count(*) >= 2 THEN sum(dx * dy) / nullif(sqrt(sum(dx * dx) * sum(dy * dy)), 0) END AS rank_correlation
FROM (SELECT sweep_id, x - avg(x) OVER (PARTITION BY sweep_id) AS dx, y - avg(y) OVER (PARTITION BY sweep_id) AS dy FROM {ranks}) q
GROUP BY sweep_id
"""
EXTRA["counters"] = """
SELECT sweep_id, count(*) AS observations,
       count(*) FILTER (WHERE kind NOT IN ('idle_baseline', 'collective')) AS invalid_types,
       count(*) FILTER (WHERE kind = 'idle_baseline') AS idle_rows,
       count(*) FILTER (WHERE kind = 'idle_baseline' AND supported AND usable AND signal IS NOT NULL) AS idle_signals,
       count(*) FILTER (WHERE kind = 'collective' AND payload IS NULL) AS invalid_payloads,
       count(*) FILTER (WHERE NOT supported) AS unsupported,
       count(*) FILTER (WHERE coalesce(measured_duration_seconds, 0) < 30) AS short_durations,
       count(*) FILTER (WHERE coalesce(abs(mean_interval_s - requested_interval_s) / requested_interval_s > CAST(0.1 AS DOUBLE), true)) AS invalid_intervals,
       count(*) FILTER (WHERE coalesce(exit_status IN ('failed', 'timeout'), false) OR NOT participation_valid) AS worker_failures
FROM {prepared} GROUP BY sweep_id
"""
EXTRA["totals"] = """
SELECT sweep_id, count(median_signal) AS usable_sizes,
       CASE WHEN count(*) FILTER (WHERE median_signal > 0) >= 2
            THEN max(median_signal) FILTER (WHERE median_signal > 0) / min(median_signal) FILTER (WHERE median_signal > 0) END AS dynamic_range,
       count(*) FILTER (WHERE reliable) AS reliable_count, count(*) FILTER (WHERE NOT reliable) AS unreliable_count,
       coalesce(string_agg(CAST(CAST(payload AS BIGINT) AS VARCHAR), ',' ORDER BY payload) FILTER (WHERE reliable), '') AS reliable_payloads,
       coalesce(string_agg(CAST(CAST(payload AS BIGINT) AS VARCHAR), ',' ORDER BY payload) FILTER (WHERE NOT reliable), '') AS unreliable_payloads,
       CAST(sum(usable_repetitions) AS BIGINT) AS usable_observations,
       CAST(sum(invalid_participation) AS BIGINT) AS invalid_participation, CAST(sum(invalid_signal) AS BIGINT) AS invalid_signal
FROM {summaries} GROUP BY sweep_id
"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prepare(view(spark, sf_dir, "observations"), RULES)


@query(
    "calibration_usable_rows",
    "P-06 P-07 P-08",
    f"SELECT run_id, sweep_id, kind, {r_sql('payload')} AS payload, {r_sql('signal')} AS signal, usable FROM {{prepared}}",
    EXTRA,
)
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(
        prepared(spark, sf_dir).select("run_id", "sweep_id", "kind", "payload", "signal", "usable")
    )


@query(
    "calibration_idle_baseline",
    "A-21 A-29",
    f"""SELECT sweep_id, idle_usable, {r_sql("idle_median")} AS idle_median, {r_sql("idle_mad")} AS idle_mad,
               idle_complete, {r_sql("capture_threshold")} AS capture_threshold FROM {{baseline}}""",
    EXTRA,
)
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(C.idle_baseline(prepared(spark, sf_dir), RULES))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir)
    return C.payload_summaries(rows, C.idle_baseline(rows, RULES), RULES)


@query(
    "calibration_payload_summaries",
    "A-22",
    f"""SELECT sweep_id, payload, repetitions, usable_repetitions, {r_sql("median_signal")} AS median_signal,
               {r_sql("mean_signal")} AS mean_signal, {r_sql("mad_signal")} AS mad_signal,
               {r_sql("cv")} AS coefficient_of_variation, captured AS capture_success_count,
               {r_sql("capture_rate")} AS capture_rate, reliable AS reliably_observed,
               invalid_participation, invalid_signal FROM {{summaries}}""",
    EXTRA,
)
def payload_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(summaries(spark, sf_dir))


@query(
    "calibration_rank_correlation",
    "A-23 W-01",
    f"SELECT sweep_id, {r_sql('rank_correlation')} AS rank_correlation FROM {{spearman}}",
    EXTRA,
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(C.rank_correlation(summaries(spark, sf_dir)))


@query(
    "calibration_counters",
    "A-26",
    "SELECT * FROM {counters}",
    EXTRA,
)
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diagnostic_counts(prepared(spark, sf_dir), RULES)


@query(
    "calibration_payload_lists",
    "A-24 A-25",
    f"""SELECT sweep_id, usable_sizes, {r_sql("dynamic_range")} AS dynamic_range, reliable_payloads,
               unreliable_payloads, usable_observations FROM {{totals}}""",
    EXTRA,
)
def payload_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(
        C.sweep_totals(summaries(spark, sf_dir)).select(
            "sweep_id",
            "usable_sizes",
            "dynamic_range",
            "reliable_payloads",
            "unreliable_payloads",
            "usable_observations",
        )
    )


_LADDER = """
SELECT sweep_id,
       concat_ws(',', CASE WHEN invalid_types > 0 THEN 'invalid_observation_type' END,
         CASE WHEN idle_rows = 0 THEN 'no_idle_baseline' END,
         CASE WHEN idle_signals < 3 THEN 'too_few_idle_repetitions' END,
         CASE WHEN invalid_payloads > 0 THEN 'invalid_payload' END,
         CASE WHEN unsupported > 0 THEN 'unsupported_reading' END,
         CASE WHEN idle_rows > 0 AND idle_signals = 0 THEN 'no_usable_idle_reading'
              WHEN idle_rows > idle_signals THEN 'invalid_idle_reading' END,
         CASE WHEN invalid_participation > 0 THEN 'invalid_participation' END,
         CASE WHEN invalid_signal > 0 THEN 'invalid_signal' END,
         CASE WHEN short_durations > 0 THEN 'short_duration' END,
         CASE WHEN invalid_intervals > 0 THEN 'invalid_interval' END,
         CASE WHEN usable_sizes < 3 THEN 'too_few_payload_sizes' END,
         CASE WHEN rank_correlation IS NULL OR rank_correlation < 0.7 THEN 'rank_correlation_below_minimum' END,
         CASE WHEN dynamic_range IS NULL OR dynamic_range < 1.2 THEN 'dynamic_range_below_minimum' END,
         CASE WHEN reliable_count = 0 THEN 'no_reliable_payload' END,
         CASE WHEN unreliable_count > 0 THEN 'unreliable_payloads' END) AS reasons,
       status,
       CASE WHEN status <> 'not_supported' THEN status
            WHEN invalid_types > 0 OR worker_failures > 0 THEN 'failed'
            WHEN unsupported > 0 AND usable_sizes = 0 THEN 'not_supported' ELSE 'inconclusive' END AS result_state,
       CASE status WHEN 'supported' THEN 'passed' WHEN 'partially_supported' THEN 'inconclusive' ELSE 'failed' END AS decision_state,
       status = 'supported' AND idle_complete AS capture_gate_passed
FROM (SELECT *, CASE WHEN invalid_types > 0 OR unsupported > 0 OR idle_signals = 0 OR NOT idle_complete OR usable_sizes < 3
                       OR rank_correlation IS NULL OR rank_correlation < 0.7 OR dynamic_range IS NULL OR dynamic_range < 1.2
                       OR reliable_count = 0 THEN 'not_supported'
                     WHEN invalid_payloads > 0 OR idle_rows > idle_signals OR invalid_participation > 0 OR invalid_signal > 0
                       OR short_durations > 0 OR invalid_intervals > 0 OR unreliable_count > 0 THEN 'partially_supported'
                     ELSE 'supported' END AS status
      FROM (SELECT k.*, coalesce(b.idle_complete, false) AS idle_complete, coalesce(t.usable_sizes, 0) AS usable_sizes,
                   t.dynamic_range, coalesce(t.reliable_count, 0) AS reliable_count, coalesce(t.unreliable_count, 0) AS unreliable_count,
                   coalesce(t.invalid_participation, 0) AS invalid_participation, coalesce(t.invalid_signal, 0) AS invalid_signal,
                   s.rank_correlation
            FROM {counters} k LEFT JOIN {baseline} b USING (sweep_id) LEFT JOIN {totals} t USING (sweep_id)
            LEFT JOIN {spearman} s USING (sweep_id)) j) d
"""


@query("calibration_decision", "A-27", _LADDER, EXTRA)
def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.analyze(view(spark, sf_dir, "observations"), RULES).select(
        "sweep_id",
        F.array_join("reasons", ",").alias("reasons"),
        "status",
        "result_state",
        "decision_state",
        "capture_gate_passed",
    )


@query(
    "calibration_report_order",
    "T-01",
    f"""SELECT sweep_id, run_id, kind, {r_sql("signal")} AS signal,
               row_number() OVER (PARTITION BY sweep_id, kind <> 'idle_baseline', payload
                 ORDER BY CAST(run_id AS VARCHAR), signal NULLS LAST, CAST(repetition AS VARCHAR)) AS position
        FROM {{prepared}}""",
    EXTRA,
)
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report_positions(prepared(spark, sf_dir)).select(
        "sweep_id", "run_id", "kind", rounded("signal").alias("signal"), "position"
    )
