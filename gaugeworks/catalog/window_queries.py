"""Windows, window statistics, device pairing and feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.registry import query, r_sql, round_doubles, rounded_values
from gaugeworks.functions import arrays as A
from gaugeworks.operators import window_batches as B
from gaugeworks.operators import windows as W
from gaugeworks.operators.features import numeric_candidates
from gaugeworks.schemas import TELEMETRY_FIELDS
from gaugeworks.sources.views import view

LENGTHS = (60.0, 180.0, 360.0)
TOLERANCE = 2.0
THRESHOLD = 60000.0

# --- SQL side: shared CTEs -------------------------------------------------
EXTRA: dict[str, str] = {}
EXTRA["bounds"] = """
SELECT c.run_id,
       CASE WHEN r.measurement_start_ns IS NOT NULL THEN greatest(c.s, r.measurement_start_ns)
            ELSE c.s + CAST(r.warmup_seconds * 1000000000 AS BIGINT) END AS start_ns,
       least(c.e + 1, coalesce(r.measurement_end_ns + 1, c.e + 1)) AS end_ns
FROM (SELECT run_id,
             greatest(min(mono_ns) FILTER (WHERE gpu_index = 0), min(mono_ns) FILTER (WHERE gpu_index = 1)) AS s,
             least(max(mono_ns) FILTER (WHERE gpu_index = 0), max(mono_ns) FILTER (WHERE gpu_index = 1)) AS e
      FROM {telemetry} GROUP BY run_id
      HAVING count(DISTINCT gpu_index) = 2) c
JOIN {runs} r USING (run_id)
"""
EXTRA["grid"] = """
SELECT run_id, window_seconds, k AS window_index, start_ns + k * stride AS ws, start_ns + k * stride + size AS we
FROM (SELECT b.*, l.*, unnest(generate_series(0, (end_ns - start_ns - size) // stride)) AS k
      FROM {bounds} b,
           (VALUES (CAST(60 AS DOUBLE), 60000000000, 30000000000),
                   (CAST(180 AS DOUBLE), 180000000000, 90000000000),
                   (CAST(360 AS DOUBLE), 360000000000, 180000000000)) l(window_seconds, size, stride)
      WHERE end_ns - start_ns >= size) g
"""
EXTRA["ws_all"] = f"""
SELECT g.window_seconds, g.window_index, g.ws, g.we, t.*,
       row_number() OVER (PARTITION BY t.run_id, window_seconds, window_index, gpu_index
         ORDER BY mono_ns, sequence, {", ".join(f"{f} NULLS FIRST" for f in TELEMETRY_FIELDS)}) AS rn,
       count(*) FILTER (WHERE gpu_index = 0) OVER (PARTITION BY t.run_id, window_seconds, window_index) AS n0,
       count(*) FILTER (WHERE gpu_index = 1) OVER (PARTITION BY t.run_id, window_seconds, window_index) AS n1
FROM {{grid}} g JOIN {{telemetry}} t ON t.run_id = g.run_id AND t.mono_ns >= g.ws AND t.mono_ns < g.we
"""
EXTRA["wsamp"] = "SELECT * FROM {ws_all} WHERE n0 >= 2 AND n1 >= 2"
EXTRA["clocks"] = """
SELECT run_id, window_seconds, window_index,
       list(mono_ns ORDER BY rn) FILTER (WHERE gpu_index = 0) AS l,
       list(mono_ns ORDER BY rn) FILTER (WHERE gpu_index = 1) AS r
FROM {wsamp} GROUP BY ALL
"""
# Head-to-head scan of the two clock lists; needs WITH RECURSIVE on the outer statement.
EXTRA["scan"] = """
SELECT run_id, window_seconds, window_index, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j,
       l[1] - r[1] AS delta FROM {clocks}
UNION ALL
SELECT run_id, window_seconds, window_index, ni, nj, l[ni] - r[nj] FROM (
  SELECT s.run_id, s.window_seconds, s.window_index, c.l, c.r,
         CASE WHEN abs(s.delta) <= 2000000000 OR s.delta < 0 THEN s.i + 1 ELSE s.i END AS ni,
         CASE WHEN abs(s.delta) <= 2000000000 OR s.delta > 0 THEN s.j + 1 ELSE s.j END AS nj
  FROM scan s JOIN {clocks} c USING (run_id, window_seconds, window_index)) t
WHERE ni <= len(l) AND nj <= len(r)
"""
EXTRA["pairs"] = """
SELECT run_id, window_seconds, window_index, i, j, delta,
       row_number() OVER (PARTITION BY run_id, window_seconds, window_index ORDER BY i) AS pn,
       count(*) OVER (PARTITION BY run_id, window_seconds, window_index) AS np
FROM {scan} WHERE abs(delta) <= 2000000000
"""
EXTRA["kept"] = """
SELECT run_id, window_seconds, window_index, count(*) AS n_pairs, max(abs(delta)) AS max_delta
FROM {pairs} WHERE np >= 2 GROUP BY ALL
"""
_LONG_PARTS = " UNION ALL ".join(
    f"SELECT run_id, window_seconds, window_index, gpu_index, rn, mono_ns, '{f}' AS field, {f} AS v FROM {{wsamp}}"
    for f in TELEMETRY_FIELDS
)
EXTRA["flong"] = _LONG_PARTS


def stats_sql(source: str, keys: str) -> str:
    """The fifteen statistics per group of ``source`` (keys, rn, mono_ns, v), in plain SQL."""
    k = keys
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in k.split(","))
    return f"""
SELECT {", ".join("a." + c.strip() for c in k.split(","))}, a.n_rows, a.n, a.mean, a.std, a.mn, a.mx,
       a.q[1] AS p25, a.q[2] AS p50, a.q[3] AS p75, a.q[4] AS p90, a.q[5] AS p95, b.mad,
       CASE WHEN b.sxx > 0 THEN b.sxy / b.sxx END AS slope, c.ac
FROM (SELECT {k}, count(*) AS n_rows, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx,
             quantile_cont(v, [0.25, 0.5, 0.75, 0.9, 0.95]) AS q
      FROM {source} GROUP BY {k}) a
JOIN (SELECT {k}, median(abs(v - m)) AS mad, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (v - mv)) AS sxy
      FROM (SELECT {k}, v, x, median(v) OVER p AS m, avg(v) OVER p AS mv,
                   avg(CASE WHEN v IS NOT NULL THEN x END) OVER p AS mx
            FROM (SELECT *, (mono_ns - min(mono_ns) OVER (PARTITION BY {k})) / CAST(1000000000 AS DOUBLE) AS x FROM {source}) s0
            WINDOW p AS (PARTITION BY {k})) s1
      WHERE v IS NOT NULL OR TRUE
      GROUP BY {k}) b ON {on}
LEFT JOIN (SELECT {k}, CASE WHEN count(*) >= 2 AND sum(dx * dx) > 0 AND sum(dy * dy) > 0
                   THEN sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) END AS ac
      FROM (SELECT {k}, p - avg(p) OVER w AS dx, v - avg(v) OVER w AS dy
            FROM (SELECT {k}, v, lag(v) OVER (PARTITION BY {k} ORDER BY rn) AS p FROM {source} WHERE v IS NOT NULL) s
            WHERE p IS NOT NULL WINDOW w AS (PARTITION BY {k})) s2
      GROUP BY {k}) c ON {on.replace("b.", "c.")}
"""


# A reading without value must not enter the regression.
EXTRA["fstats"] = stats_sql("flong", "run_id, window_seconds, window_index, gpu_index, field").replace(
    "flong", "{flong}"
).replace("sum((x - mx) * (x - mx))", "sum(CASE WHEN v IS NOT NULL THEN (x - mx) * (x - mx) END)")
EXTRA["tlong"] = """
SELECT run_id, window_seconds, window_index, gpu_index, rn, mono_ns,
       pcie_tx_bytes_per_s + pcie_rx_bytes_per_s AS v FROM {wsamp}
"""
EXTRA["tstats"] = stats_sql("tlong", "run_id, window_seconds, window_index, gpu_index").replace(
    "tlong", "{tlong}"
).replace("sum((x - mx) * (x - mx))", "sum(CASE WHEN v IS NOT NULL THEN (x - mx) * (x - mx) END)")
EXTRA["runs_of_activity"] = """
SELECT run_id, window_seconds, window_index, gpu_index, island, count(*) AS len, max(x) - min(x) AS span
FROM (SELECT *, sum(CASE WHEN active = was THEN 0 ELSE 1 END) OVER
               (PARTITION BY run_id, window_seconds, window_index, gpu_index ORDER BY rn) AS island
      FROM (SELECT *, v > 60000 AS active, mono_ns / CAST(1000000000 AS DOUBLE) AS x,
                   lag(v > 60000) OVER (PARTITION BY run_id, window_seconds, window_index, gpu_index ORDER BY rn) AS was
            FROM {tlong} WHERE v IS NOT NULL) a) b
WHERE active GROUP BY ALL
"""
EXTRA["tcomm"] = """
SELECT t.run_id, t.window_seconds, t.window_index, t.gpu_index, t.n, t.n_rows, t.mean, t.p50, t.mx, t.p90, t.p95, t.std, t.mad,
       CASE WHEN t.mean <> 0 THEN t.std / abs(t.mean) END AS cv, t.ac,
       f.frac, CASE WHEN t.n > 0 THEN coalesce(b.bursts, 0) END AS bursts,
       CASE WHEN t.n > 0 THEN coalesce(b.avg_span + f.step, 0) END AS avg_burst,
       CASE WHEN t.n > 0 THEN coalesce(b.max_span + f.step, 0) END AS max_burst,
       CASE WHEN t.n > 0 THEN coalesce(b.longest, 0) END AS longest
FROM {tstats} t
LEFT JOIN (SELECT run_id, window_seconds, window_index, gpu_index, coalesce(median(x - px), 0) AS step,
                  avg(CASE WHEN v > 60000 THEN 1 ELSE 0 END) AS frac
           FROM (SELECT *, lag(x) OVER (PARTITION BY run_id, window_seconds, window_index, gpu_index ORDER BY rn) AS px
                 FROM (SELECT *, mono_ns / CAST(1000000000 AS DOUBLE) AS x FROM {tlong} WHERE v IS NOT NULL) q0) q1
           GROUP BY ALL) f USING (run_id, window_seconds, window_index, gpu_index)
LEFT JOIN (SELECT run_id, window_seconds, window_index, gpu_index, count(*) AS bursts, avg(span) AS avg_span,
                  max(span) AS max_span, max(len) AS longest
           FROM {runs_of_activity} GROUP BY ALL) b USING (run_id, window_seconds, window_index, gpu_index)
"""
EXTRA["device"] = """
SELECT run_id, window_seconds, window_index, gpu_index,
       avg(CASE WHEN gpu_utilization_pct <= 5 THEN 1 ELSE 0 END) AS idle_fraction,
       avg(CASE WHEN gpu_utilization_pct > 5 THEN 1 ELSE 0 END) AS duty_cycle,
       avg(pcie_tx_bytes_per_s + pcie_rx_bytes_per_s) AS total_mean,
       avg(CASE WHEN pcie_rx_bytes_per_s IS NOT NULL THEN pcie_tx_bytes_per_s END)
         / nullif(avg(CASE WHEN pcie_tx_bytes_per_s IS NOT NULL THEN pcie_rx_bytes_per_s END), 0) AS tx_rx_ratio
FROM {wsamp} GROUP BY ALL
"""
EXTRA["pair_rows"] = f"""
SELECT p.run_id, p.window_seconds, p.window_index, p.pn,
       {", ".join(f"a.{f} AS l_{f}, b.{f} AS r_{f}" for f in TELEMETRY_FIELDS)}
FROM {{pairs}} p
JOIN {{wsamp}} a ON a.run_id = p.run_id AND a.window_seconds = p.window_seconds AND a.window_index = p.window_index AND a.gpu_index = 0 AND a.rn = p.i
JOIN {{wsamp}} b ON b.run_id = p.run_id AND b.window_seconds = p.window_seconds AND b.window_index = p.window_index AND b.gpu_index = 1 AND b.rn = p.j
WHERE p.np >= 2
"""
EXTRA["pair_long"] = " UNION ALL ".join(
    f"SELECT run_id, window_seconds, window_index, pn, '{f}' AS field, l_{f} AS x, r_{f} AS y FROM {{pair_rows}}"
    for f in TELEMETRY_FIELDS
)
EXTRA["cross_stats"] = """
SELECT run_id, window_seconds, window_index, field, avg(abs(x - y)) AS diff, avg(abs(x) + abs(y)) / 2 AS scale,
       CASE WHEN count(*) >= 2 AND sum(dx * dx) > 0 AND sum(dy * dy) > 0 THEN sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) END AS corr_v,
       CASE WHEN count(ny) >= 2 AND sum(ex * ex) > 0 AND sum(ey * ey) > 0 THEN sum(ex * ey) / sqrt(sum(ex * ex) * sum(ey * ey)) END AS lag_v
FROM (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy,
             CASE WHEN ny IS NOT NULL THEN x - avg(CASE WHEN ny IS NOT NULL THEN x END) OVER w END AS ex,
             ny - avg(ny) OVER w AS ey
      FROM (SELECT *, lead(y) OVER (PARTITION BY run_id, window_seconds, window_index, field ORDER BY pn) AS ny
            FROM {pair_long} WHERE x IS NOT NULL AND y IS NOT NULL) q
      WINDOW w AS (PARTITION BY run_id, window_seconds, window_index, field)) z
GROUP BY ALL
"""
EXTRA["position_pairs"] = """
SELECT run_id, window_seconds, window_index, a.v AS x, b.v AS y
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, window_seconds, window_index ORDER BY rn) AS pos
      FROM {tlong} WHERE v IS NOT NULL AND gpu_index = 0) a
JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, window_seconds, window_index ORDER BY rn) AS pos
      FROM {tlong} WHERE v IS NOT NULL AND gpu_index = 1) b USING (run_id, window_seconds, window_index, pos)
"""
EXTRA["time_pairs"] = """
SELECT run_id, window_seconds, window_index, l_pcie_tx_bytes_per_s + l_pcie_rx_bytes_per_s AS x,
       r_pcie_tx_bytes_per_s + r_pcie_rx_bytes_per_s AS y
FROM {pair_rows}
WHERE l_pcie_tx_bytes_per_s + l_pcie_rx_bytes_per_s IS NOT NULL AND r_pcie_tx_bytes_per_s + r_pcie_rx_bytes_per_s IS NOT NULL
"""


def _traffic_sql(source: str) -> str:
    return f"""
SELECT run_id, window_seconds, window_index,
       CASE WHEN count(*) >= 2 AND sum(dx * dx) > 0 AND sum(dy * dy) > 0 THEN sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) END AS c,
       CASE WHEN avg(abs(x) + abs(y)) = 0 THEN 0 ELSE avg(abs(x - y)) / (avg(abs(x) + abs(y)) / 2) END AS a
FROM (SELECT *, x - avg(x) OVER (PARTITION BY run_id, window_seconds, window_index) AS dx,
             y - avg(y) OVER (PARTITION BY run_id, window_seconds, window_index) AS dy FROM {{{source}}}) q
GROUP BY ALL
"""


EXTRA["by_position"] = _traffic_sql("position_pairs")
EXTRA["by_time"] = _traffic_sql("time_pairs")


# --- Spark side ------------------------------------------------------------
def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    telemetry = view(spark, sf_dir, "telemetry")
    bounds = W.run_bounds(telemetry, view(spark, sf_dir, "runs"))
    return W.assign_windows(telemetry, bounds, LENGTHS)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    telemetry = view(spark, sf_dir, "telemetry")
    return W.block_samples(telemetry, W.run_bounds(telemetry, view(spark, sf_dir, "runs")), LENGTHS)


@query(
    "run_bounds",
    "P-04 J-16 F-03",
    "SELECT run_id, start_ns, end_ns FROM {bounds}",
    EXTRA,
)
def run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.run_bounds(view(spark, sf_dir, "telemetry"), view(spark, sf_dir, "runs")).select(
        "run_id", "start_ns", "end_ns"
    )


@query(
    "window_sample_counts",
    "W-04 J-02 A-18",
    """SELECT run_id, window_seconds, window_index, ws AS window_start_ns, we AS window_end_ns,
              count(*) FILTER (WHERE gpu_index = 0) AS sample_count_gpu0,
              count(*) FILTER (WHERE gpu_index = 1) AS sample_count_gpu1
       FROM {wsamp} GROUP BY ALL""",
    EXTRA,
)
def window_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        assigned(spark, sf_dir)
        .groupBy("run_id", "block", *W.WINDOW_KEYS[1:], "window_start_ns", "window_end_ns")
        .agg(
            *[
                F.count(F.when(F.col("gpu_index") == g, 1)).alias(f"sample_count_gpu{g}")
                for g in (0, 1)
            ]
        )
        .where("sample_count_gpu0 >= 2 AND sample_count_gpu1 >= 2")
        .drop("block")
    )


_STAT_SELECT = f"""
SELECT run_id, window_seconds, window_index, gpu_index, field,
       {r_sql("mean")} AS mean, {r_sql("std")} AS std, {r_sql("mn")} AS min, {r_sql("mx")} AS max,
       {r_sql("p25")} AS p25, {r_sql("p50")} AS p50, {r_sql("p75")} AS p75, {r_sql("p90")} AS p90, {r_sql("p95")} AS p95,
       {r_sql("mad")} AS mad, {r_sql("(p75 - p25)")} AS iqr, {r_sql("(mx - mn)")} AS range,
       {r_sql("(CASE WHEN mean <> 0 THEN std / abs(mean) END)")} AS cv, {r_sql("slope")} AS slope, {r_sql("ac")} AS autocorr_lag1,
       {r_sql("(1 - n / CAST(n_rows AS DOUBLE))")} AS missing_fraction
FROM {{fstats}}
"""


@query(
    "window_field_stats",
    "P-01 P-03 A-01 A-02 A-03 A-04 A-05 A-06 A-07 A-08 A-09 W-02 W-09 W-10",
    _STAT_SELECT,
    EXTRA,
)
def window_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(B.field_table(samples(spark, sf_dir), LENGTHS, TELEMETRY_FIELDS))


@query(
    "window_device_summary",
    "A-10 A-11 P-02",
    f"""SELECT run_id, window_seconds, window_index, gpu_index,
               {r_sql("idle_fraction")} AS utilization_idle_fraction, {r_sql("duty_cycle")} AS utilization_duty_cycle,
               {r_sql("total_mean")} AS pcie_total_mean_bytes_per_s, {r_sql("tx_rx_ratio")} AS pcie_tx_rx_ratio
        FROM {{device}}""",
    EXTRA,
)
def window_device_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(B.device_table(samples(spark, sf_dir), LENGTHS))


@query(
    "window_communication",
    "A-12 A-13 A-14 W-03 P-02",
    f"""SELECT run_id, window_seconds, window_index, gpu_index,
               {r_sql("mean")} AS mean, {r_sql("p50")} AS median, {r_sql("mx")} AS maximum, {r_sql("p90")} AS p90, {r_sql("p95")} AS p95,
               {r_sql("std")} AS std, {r_sql("mad")} AS mad, {r_sql("cv")} AS coefficient_of_variation,
               {r_sql("ac")} AS periodicity_lag1_autocorrelation,
               {r_sql("(n / CAST(n_rows AS DOUBLE))")} AS sampling_validity_fraction,
               {r_sql("(frac)")} AS fraction_above_idle_threshold, {r_sql("(frac)")} AS communication_duty_cycle,
               bursts AS burst_count, {r_sql("(avg_burst)")} AS average_burst_duration_s,
               {r_sql("(max_burst)")} AS maximum_burst_duration_s, longest AS longest_consecutive_burst,
               {r_sql("(1 - frac)")} AS near_idle_sample_fraction
        FROM {{tcomm}}""",
    EXTRA,
)
def window_communication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(B.communication_table(samples(spark, sf_dir), LENGTHS, THRESHOLD))


@query(
    "aligned_pairs",
    "J-01",
    """WITH RECURSIVE out AS (SELECT 1)
       SELECT p.run_id, p.window_seconds, p.window_index, a.mono_ns AS left_ns, b.mono_ns AS right_ns,
              a.sequence AS left_sequence, b.sequence AS right_sequence
       FROM {pairs} p
       JOIN {wsamp} a ON a.run_id = p.run_id AND a.window_seconds = p.window_seconds AND a.window_index = p.window_index AND a.gpu_index = 0 AND a.rn = p.i
       JOIN {wsamp} b ON b.run_id = p.run_id AND b.window_seconds = p.window_seconds AND b.window_index = p.window_index AND b.gpu_index = 1 AND b.rn = p.j
       WHERE p.np >= 2""",
    EXTRA,
)
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pair_table(samples(spark, sf_dir), LENGTHS, TOLERANCE)


@query(
    "aligned_window_counts",
    "A-18",
    f"""WITH RECURSIVE out AS (SELECT 1)
       SELECT run_id, window_seconds, window_index, n_pairs AS aligned_sample_pairs,
              {r_sql("(max_delta / CAST(1000000000 AS DOUBLE))")} AS alignment_max_delta_seconds
       FROM {{kept}}""",
    EXTRA,
)
def aligned_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(B.alignment_table(samples(spark, sf_dir), LENGTHS, TOLERANCE))


@query(
    "cross_device_stats",
    "A-15 A-16",
    f"""WITH RECURSIVE out AS (SELECT 1)
        SELECT run_id, window_seconds, window_index, field, {r_sql("diff")} AS mean_abs_difference,
               {r_sql("(diff / nullif(scale, 0))")} AS normalized_divergence,
               {r_sql("corr_v")} AS correlation, {r_sql("lag_v")} AS lag1_correlation
        FROM {{cross_stats}}""",
    EXTRA,
)
def cross_device_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(B.cross_table(samples(spark, sf_dir), LENGTHS, TELEMETRY_FIELDS, TOLERANCE))


@query(
    "cross_device_traffic",
    "A-17",
    f"""WITH RECURSIVE out AS (SELECT 1)
        SELECT k.run_id, k.window_seconds, k.window_index, {r_sql("p.c")} AS correlation, {r_sql("p.a")} AS asymmetry,
               {r_sql("t.c")} AS correlation_aligned, {r_sql("t.a")} AS asymmetry_aligned
        FROM {{kept}} k
        LEFT JOIN {{by_position}} p USING (run_id, window_seconds, window_index)
        LEFT JOIN {{by_time}} t USING (run_id, window_seconds, window_index)""",
    EXTRA,
)
def cross_device_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(B.traffic_table(samples(spark, sf_dir), LENGTHS, TOLERANCE))


_S = {"min": "mn", "max": "mx", "iqr": "(p75 - p25)", "range": "(mx - mn)", "autocorr_lag1": "ac",
      "cv": "(CASE WHEN mean <> 0 THEN std / abs(mean) END)"}
_C = {"mean": "mean", "median": "p50", "maximum": "mx", "p90": "p90", "p95": "p95", "std": "std", "mad": "mad",
      "coefficient_of_variation": "cv", "periodicity_lag1_autocorrelation": "ac",
      "sampling_validity_fraction": "(n / CAST(n_rows AS DOUBLE))", "fraction_above_idle_threshold": "frac",
      "communication_duty_cycle": "frac", "burst_count": "bursts", "average_burst_duration_s": "avg_burst",
      "maximum_burst_duration_s": "max_burst", "longest_consecutive_burst": "longest",
      "near_idle_sample_fraction": "(1 - frac)"}
_D = {"utilization_idle_fraction": "idle_fraction", "utilization_duty_cycle": "duty_cycle",
      "pcie_total_mean_bytes_per_s": "total_mean", "pcie_tx_rx_ratio": "tx_rx_ratio"}
_X = {"mean_abs_difference": "diff", "normalized_divergence": "(diff / nullif(scale, 0))",
      "correlation": "corr_v", "lag1_correlation": "lag_v"}
_KEYS = "run_id, window_seconds, window_index"


def _wide_sql() -> str:
    def whole(name: str, sql: str) -> str:
        return sql if name in ("burst_count", "longest_consecutive_burst") else r_sql(sql)

    stats = ", ".join(
        f"max(CASE WHEN gpu_index = {g} AND field = '{f}' THEN {r_sql(_S.get(s, s))} END) AS gpu{g}__{f}__{s}"
        for g in (0, 1) for f in TELEMETRY_FIELDS for s in A.STAT_NAMES
    )
    missing = ", ".join(
        f"max(CASE WHEN gpu_index = {g} AND field = '{f}' THEN {r_sql("(1 - n / CAST(n_rows AS DOUBLE))")} END) AS gpu{g}__{f}__missing_fraction"
        for g in (0, 1) for f in TELEMETRY_FIELDS
    )
    device = ", ".join(
        f"max(CASE WHEN gpu_index = {g} THEN {r_sql(sql)} END) AS gpu{g}__{n}" for g in (0, 1) for n, sql in _D.items()
    )
    comm = ", ".join(
        f"max(CASE WHEN gpu_index = {g} THEN {whole(n, sql)} END) AS gpu{g}__pcie_total__{n}"
        for g in (0, 1) for n, sql in _C.items()
    )
    cross = ", ".join(
        f"max(CASE WHEN field = '{f}' THEN {r_sql(sql)} END) AS cross_gpu__{f}__{n}"
        for f in TELEMETRY_FIELDS for n, sql in _X.items()
    )
    return f"""WITH RECURSIVE out AS (SELECT 1)
SELECT k.run_id, k.window_seconds, k.window_index, c.window_start_ns, c.window_end_ns, c.sample_count_gpu0, c.sample_count_gpu1,
       k.n_pairs AS aligned_sample_pairs, {r_sql("(k.max_delta / CAST(1000000000 AS DOUBLE))")} AS alignment_max_delta_seconds,
       s.* EXCLUDE ({_KEYS}), d.* EXCLUDE ({_KEYS}), m.* EXCLUDE ({_KEYS}), x.* EXCLUDE ({_KEYS}),
       {r_sql("p.c")} AS cross_gpu__pcie_total__correlation, {r_sql("p.a")} AS cross_gpu__pcie_total__asymmetry,
       {r_sql("t.c")} AS cross_gpu__pcie_total__correlation_aligned, {r_sql("t.a")} AS cross_gpu__pcie_total__asymmetry_aligned
FROM {{kept}} k
JOIN (SELECT {_KEYS}, min(ws) AS window_start_ns, min(we) AS window_end_ns,
             count(*) FILTER (WHERE gpu_index = 0) AS sample_count_gpu0, count(*) FILTER (WHERE gpu_index = 1) AS sample_count_gpu1
      FROM {{wsamp}} GROUP BY {_KEYS}) c USING ({_KEYS})
JOIN (SELECT {_KEYS}, {stats}, {missing} FROM {{fstats}} GROUP BY {_KEYS}) s USING ({_KEYS})
JOIN (SELECT {_KEYS}, {device} FROM {{device}} GROUP BY {_KEYS}) d USING ({_KEYS})
JOIN (SELECT {_KEYS}, {comm} FROM {{tcomm}} GROUP BY {_KEYS}) m USING ({_KEYS})
LEFT JOIN (SELECT {_KEYS}, {cross} FROM {{cross_stats}} GROUP BY {_KEYS}) x USING ({_KEYS})
LEFT JOIN {{by_position}} p USING ({_KEYS})
LEFT JOIN {{by_time}} t USING ({_KEYS})"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.feature_table(samples(spark, sf_dir), LENGTHS, TELEMETRY_FIELDS, TOLERANCE, THRESHOLD)


@query(
    "feature_rows",
    "A-01 A-02 A-03 A-04 A-05 A-06 A-07 A-08 A-09 A-10 A-11 A-12 A-13 A-14 A-15 A-16 A-17 A-18",
    _wide_sql(),
    EXTRA,
)
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(features(spark, sf_dir))


_RECURSIVE = "WITH RECURSIVE out AS (SELECT 1)\n"
EXTRA["wide_rows"] = _wide_sql().removeprefix(_RECURSIVE)
_NOT_MEANS = (
    "window_index", "window_start_ns", "window_end_ns", "sample_count_gpu0", "sample_count_gpu1", "aligned_sample_pairs",
    "alignment_max_delta_seconds",
)


@query(
    "feature_run_means",
    "A-19 W-05",
    _RECURSIVE
    + f"""SELECT run_id, window_seconds, column_name, count(*) AS filled_windows, {r_sql("avg(v)")} AS mean
FROM (UNPIVOT (SELECT run_id, window_seconds, CAST(COLUMNS(* EXCLUDE (run_id, window_seconds, {", ".join(_NOT_MEANS)})) AS DOUBLE) FROM {{wide_rows}})
      ON COLUMNS(* EXCLUDE (run_id, window_seconds)) INTO NAME column_name VALUE v) u
GROUP BY run_id, window_seconds, column_name""",
    EXTRA,
)
def feature_run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-level mean of every numeric feature column, one row per run, window length and column."""
    columns = numeric_candidates(features(spark, sf_dir).drop("window_start_ns", "window_end_ns"))
    return round_doubles(
        B.feature_means(samples(spark, sf_dir), LENGTHS, TELEMETRY_FIELDS, TOLERANCE, THRESHOLD, columns, rounded_values)
    )
