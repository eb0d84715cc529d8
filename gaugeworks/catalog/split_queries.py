"""Run groups, splits, folds and the leakage audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.registry import query
from gaugeworks.operators import splits as S
from gaugeworks.sources.views import view

REQUIRED = ("ddp_training", "control_idle")
COLUMNS = ("gpu0__power_draw_w__mean", "session_offset", "source_path_id", "pcie_total__mean")

EXTRA: dict[str, str] = {}
EXTRA["grp"] = """
SELECT run_id, min(experiment_session_id) AS experiment_session_id, min(target_label) AS target_label,
       min(workload_family) AS workload_family, min(workload_config_id) AS workload_config_id, count(*) AS window_count,
       concat_ws(',', CASE WHEN bool_or(legacy_grouping_ambiguous) THEN 'ambiguous_legacy_grouping' END,
         CASE WHEN count(*) > count(experiment_session_id) THEN 'missing_experiment_session_id' END,
         CASE WHEN count(DISTINCT workload_config_id) > 1 THEN 'multiple_workload_config_id' END) AS violations
FROM {feature_index} GROUP BY run_id
"""
EXTRA["ok"] = "SELECT * FROM {grp} WHERE violations = ''"
EXTRA["strata"] = """
SELECT *, count(*) OVER (PARTITION BY stratum) AS n,
       row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('20260730:', stratum, ':', CAST(run_id AS VARCHAR)))) - 1 AS position
FROM (SELECT *, CASE WHEN workload_family IN ('ddp_training', 'control_idle') THEN concat('family:', workload_family)
                     ELSE concat('class:', target_label) END AS stratum FROM {ok}) s
"""
EXTRA["stratified"] = """
SELECT *, CASE WHEN n < 3 THEN NULL WHEN position < t THEN 'test' WHEN position < t + v THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, greatest(1, t0 - (excess - least(excess, v0 - 1))) AS t, v0 - least(excess, v0 - 1) AS v
      FROM (SELECT *, greatest(0, t0 + v0 - (n - 1)) AS excess
            FROM (SELECT *, greatest(1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS t0,
                         greatest(1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS v0 FROM {strata}) a) b) c
"""
EXTRA["pair"] = """WITH tags AS (SELECT DISTINCT experiment_session_id AS s, concat('class:', target_label) AS tag FROM {ok}),
            cand AS (SELECT s FROM tags GROUP BY s HAVING count(*) = (SELECT count(DISTINCT tag) FROM tags)),
            pairs AS (SELECT t.s AS ts, v.s AS vs FROM cand t, cand v WHERE t.s <> v.s
                      AND NOT EXISTS (SELECT tag FROM tags GROUP BY tag
                        HAVING count(*) FILTER (WHERE s <> t.s AND s <> v.s) = 0))
       SELECT first(ts ORDER BY sha256(concat('20260730:test:', ts)), sha256(concat('20260730:validation:', vs))) AS test_session,
              first(vs ORDER BY sha256(concat('20260730:test:', ts)), sha256(concat('20260730:validation:', vs))) AS validation_session
       FROM pairs"""
# The same split with classes as the only strata.
EXTRA["class_strata"] = """
SELECT *, count(*) OVER (PARTITION BY stratum) AS n,
       row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('20260730:', stratum, ':', CAST(run_id AS VARCHAR)))) - 1 AS position
FROM (SELECT *, concat('class:', target_label) AS stratum FROM {ok}) s
"""
EXTRA["class_stratified"] = EXTRA["stratified"].replace("{strata}", "{class_strata}")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.valid_groups(view(spark, sf_dir, "feature_index"))


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(groups(spark, sf_dir), REQUIRED)


@query(
    "run_groups",
    "V-01 X-05 W-05",
    """SELECT run_id, experiment_session_id, target_label, workload_family, workload_config_id, window_count, violations FROM {grp}""",
    EXTRA,
)
def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_groups(view(spark, sf_dir, "feature_index")).withColumn(
        "violations", F.array_join("violations", ",")
    )


@query(
    "stratified_split",
    "V-03 W-07 F-06 J-14",
    "SELECT run_id, stratum, position, split FROM {stratified}",
    EXTRA,
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(spark, sf_dir).select("run_id", "stratum", "position", "split")


@query("session_holdout", "V-02", EXTRA["pair"], EXTRA)
def session_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_holdout(groups(spark, sf_dir))


_HOLD = """
SELECT '{field}' AS holdout_field, v.value AS holdout_value, l.target_label,
       count(g.run_id) FILTER (WHERE g.{field} = v.value) AS test_runs,
       CASE WHEN count(g.run_id) FILTER (WHERE g.{field} <> v.value) >= 2
            THEN first(g.run_id ORDER BY sha256(concat('20260730:{field}:', l.target_label, ':', CAST(g.run_id AS VARCHAR))))
                 FILTER (WHERE g.{field} <> v.value) END AS validation_run_id,
       count(g.run_id) FILTER (WHERE g.{field} <> v.value)
         - CASE WHEN count(g.run_id) FILTER (WHERE g.{field} <> v.value) >= 2 THEN 1 ELSE 0 END AS train_runs
FROM (SELECT DISTINCT {field} AS value FROM {ok}) v, (SELECT DISTINCT target_label FROM {ok}) l
JOIN {ok} g ON g.target_label = l.target_label
GROUP BY v.value, l.target_label
"""


@query("family_holdout_sweep", "V-04 V-09", _HOLD.replace("{field}", "workload_family"), EXTRA)
def family_holdout_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout_sweep(groups(spark, sf_dir), "workload_family")


@query("configuration_holdout_sweep", "V-04 V-09", _HOLD.replace("{field}", "workload_config_id"), EXTRA)
def configuration_holdout_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout_sweep(groups(spark, sf_dir), "workload_config_id")


@query(
    "family_holdout_split",
    "V-04",
    """SELECT g.run_id, CASE WHEN workload_family = 'control_compute' THEN 'test'
              WHEN n >= 2 AND rn = 1 THEN 'validation' ELSE 'train' END AS split
       FROM (SELECT *, row_number() OVER (PARTITION BY target_label, workload_family = 'control_compute'
                    ORDER BY sha256(concat('20260730:workload_family:', target_label, ':', CAST(run_id AS VARCHAR)))) AS rn,
                    count(*) OVER (PARTITION BY target_label, workload_family = 'control_compute') AS n FROM {ok}) g""",
    EXTRA,
)
def family_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout_split(groups(spark, sf_dir), "workload_family", "control_compute").select(
        "run_id", "split"
    )


@query(
    "run_kfold_roles",
    "V-07 W-06 J-15 X-02",
    """SELECT run_id, f.fold, CASE WHEN pos % 5 = f.fold THEN 'test' ELSE 'train' END AS role
       FROM (SELECT run_id, row_number() OVER (ORDER BY CAST(run_id AS VARCHAR)) - 1 AS pos FROM {ok}) g,
            (SELECT unnest(generate_series(0, 4)) AS fold) f""",
    EXTRA,
)
def run_kfold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_roles(S.group_kfold(groups(spark, sf_dir), "run_id", 5), 5)


@query(
    "leave_one_session_out",
    "V-07",
    """SELECT run_id, experiment_session_id AS fold_group, dense_rank() OVER (ORDER BY experiment_session_id) - 1 AS test_fold FROM {ok}""",
    EXTRA,
)
def leave_one_session_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leave_one_group_out(groups(spark, sf_dir), "experiment_session_id")


@query(
    "split_counts",
    "V-05 A-63",
    """SELECT split, field, value, count(*) AS runs FROM (
         SELECT split, 'target_label' AS field, target_label AS value FROM {stratified} UNION ALL
         SELECT split, 'workload_family', workload_family FROM {stratified} UNION ALL
         SELECT split, 'workload_config_id', workload_config_id FROM {stratified} UNION ALL
         SELECT split, 'experiment_session_id', experiment_session_id FROM {stratified}) q
       WHERE split IS NOT NULL GROUP BY split, field, value""",
    EXTRA,
)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_counts(stratified(spark, sf_dir))


@query(
    "split_problems",
    "V-05 X-01",
    """SELECT 'missing_' || kind AS problem, s.split, e.value, 'error' AS severity
       FROM (SELECT DISTINCT 'class' AS kind, target_label AS value FROM {stratified} UNION ALL
             SELECT * FROM (VALUES ('family', 'ddp_training'), ('family', 'control_idle'), ('family', 'peer_copy')) f) e,
            (VALUES ('train'), ('validation'), ('test')) s(split)
       WHERE NOT EXISTS (SELECT 1 FROM {stratified} t WHERE t.split = s.split
                         AND CASE e.kind WHEN 'class' THEN t.target_label ELSE t.workload_family END = e.value)
       UNION ALL SELECT DISTINCT 'stratum_too_small', '', stratum, 'error' FROM {stratified} WHERE split IS NULL""",
    EXTRA,
)
def split_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_problems(stratified(spark, sf_dir), (*REQUIRED, "peer_copy"))


@query(
    "split_run_lists",
    "T-05",
    """SELECT split, experiment_session_id, count(*) AS runs, string_agg(DISTINCT workload_family, ',' ORDER BY workload_family) AS families
       FROM {stratified} GROUP BY split, experiment_session_id""",
    EXTRA,
)
def split_run_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        stratified(spark, sf_dir)
        .groupBy("split", "experiment_session_id")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.array_join(F.array_sort(F.collect_set("workload_family")), ",").alias("families"),
        )
    )


@query(
    "leakage_audit",
    "V-08",
    """SELECT 'session_offset,source_path_id' AS forbidden_columns,
              (SELECT count(*) FROM (SELECT run_id FROM (SELECT run_id, split FROM {stratified} UNION ALL
                 SELECT run_id, CASE WHEN violations <> '' THEN 'train' ELSE NULL END FROM {grp}) u GROUP BY run_id
                 HAVING min(split) <> max(split)) q) AS split_leak_runs,
              (SELECT count(DISTINCT run_id) FROM {feature_index} WHERE run_id NOT IN
                 (SELECT run_id FROM {stratified} WHERE split IS NOT NULL)) AS runs_without_split,
              (SELECT count(DISTINCT l) > 1 FROM (SELECT target_label, list(DISTINCT window_seconds ORDER BY window_seconds) AS l
                 FROM {feature_index} GROUP BY target_label) z) AS class_specific_window_lengths,
              (SELECT count(DISTINCT run_id) FROM {feature_index}
               WHERE legacy_grouping_ambiguous OR coalesce(experiment_session_id = '', true)) AS ambiguous_runs,
              false AS passed""",
    EXTRA,
)
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "feature_index")
    return S.audit_leakage(rows, COLUMNS, stratified(spark, sf_dir).select("run_id", "split"))


@query(
    "split_strategy",
    "V-06",
    """SELECT split, count(*) AS runs, strategy FROM (
         SELECT CASE experiment_session_id WHEN test_session THEN 'test' WHEN validation_session THEN 'validation' ELSE 'train' END AS split,
                'independent_session_holdout' AS strategy FROM {ok}, {pair} WHERE test_session IS NOT NULL
         UNION ALL SELECT split, 'deterministic_class_stratified_whole_run' FROM {class_stratified}, {pair} WHERE test_session IS NULL) q
       GROUP BY split, strategy""",
    EXTRA,
)
def split_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy, assigned = S.choose_strategy(groups(spark, sf_dir), ())
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("runs")).withColumn(
        "strategy", F.lit(strategy)
    )
