"""Detector metrics, selection and uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.catalog.registry import query, r_sql, round_doubles
from gaugeworks.operators import metrics as M
from gaugeworks.schemas import TARGET_LABELS
from gaugeworks.sources.views import view

T = 0.35

EXTRA: dict[str, str] = {}
_CONF = """count(*) FILTER (WHERE y = 1 AND p >= 0.35) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.35) AS fp,
       count(*) FILTER (WHERE y = 1 AND p < 0.35) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.35) AS tn"""


def _derived_sql(source: str, keys: str) -> str:
    parts = {
        "accuracy": "(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)",
        "balanced_accuracy": "(tp / nullif(CAST(tp + fn AS DOUBLE), 0) + tn / nullif(CAST(tn + fp AS DOUBLE), 0)) / 2",
        "precision": "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)",
        "recall": "coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)",
        "f1": "coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)",
        "training_recall": "tp / nullif(CAST(tp + fn AS DOUBLE), 0)",
        "inference_recall": "tn / nullif(CAST(tn + fp AS DOUBLE), 0)",
        "false_positive_rate": "fp / nullif(CAST(tn + fp AS DOUBLE), 0)",
        "false_negative_rate": "fn / nullif(CAST(tp + fn AS DOUBLE), 0)",
        "nontraining_precision": "tn / nullif(CAST(tn + fn AS DOUBLE), 0)",
        "training_precision": "tp / nullif(CAST(tp + fp AS DOUBLE), 0)",
    }
    return f"""SELECT {keys}, tp, fp, fn, tn, tp + fp + fn + tn AS sample_count,
       {", ".join(f"{r_sql('(' + sql + ')')} AS {name}" for name, sql in parts.items())},
       tp + fn = 0 OR tn + fp = 0 AS one_class FROM ({source}) q"""


EXTRA["levels"] = """
SELECT split, p, sum(y) AS pos, sum(1 - y) AS neg FROM {scores} GROUP BY split, p
"""
EXTRA["cumulated"] = """
SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {levels} WINDOW w AS (PARTITION BY split ORDER BY p DESC)
"""
# Means of whole billionths: a mean at an end of the band does not hang on the order of the sum.
EXTRA["by_run_exact"] = f"""
SELECT run_id, CAST(CAST(sum(CAST(round(p * {M.SCORE_PARTS}) AS BIGINT)) AS BIGINT) AS DOUBLE) / (count(p) * CAST({M.SCORE_PARTS} AS DOUBLE)) AS p,
       max(y) AS y
FROM {{scores}} GROUP BY run_id
"""
EXTRA["by_run"] = "SELECT run_id, avg(p) AS p, max(y) AS y FROM {scores} GROUP BY run_id"
EXTRA["outcomes"] = """
SELECT run_id, y, p, CASE WHEN y = 1 AND p >= 0.35 THEN 1 WHEN y = 1 THEN 2 WHEN p < 0.35 THEN 3 ELSE 4 END AS cell FROM {by_run}
"""
EXTRA["resampled"] = """
SELECT rep, count(*) FILTER (WHERE cell = 1) AS tp, count(*) FILTER (WHERE cell = 2) AS fn,
       count(*) FILTER (WHERE cell = 3) AS tn, count(*) FILTER (WHERE cell = 4) AS fp
FROM (SELECT rep, CAST(concat('0x', substr(sha256(concat('20260730:', CAST(rep AS VARCHAR), ':', CAST(draw AS VARCHAR))), 1, 12)) AS BIGINT)
               % (SELECT count(*) FROM {outcomes}) AS at
      FROM (SELECT unnest(generate_series(1, 500)) AS rep) r, (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM {outcomes}))) AS draw) d) x
JOIN (SELECT cell, row_number() OVER (ORDER BY cell, run_id) - 1 AS pos FROM {outcomes}) o ON o.pos = x.at
GROUP BY rep
"""
EXTRA["boot"] = """
SELECT list(s ORDER BY s) AS s, count(*) AS m FROM (
  SELECT (tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2 AS s FROM {resampled}
  WHERE tp + fn > 0 AND tn + fp > 0 AND (SELECT count(*) FROM {outcomes}) >= 20) q
"""
EXTRA["models"] = """
SELECT y, m.model, m.model_order, CASE m.model WHEN 'rule' THEN p WHEN 'inverse' THEN 1 - p ELSE CAST(0.25 AS DOUBLE) + p / 2 END AS p
FROM {scores}, (VALUES ('majority', 0), ('rule', 1), ('inverse', 2)) m(model, model_order) WHERE split = 'validation'
"""
EXTRA["grid_table"] = """
SELECT model, model_order, t / CAST(20 AS DOUBLE) AS threshold,
       (count(*) FILTER (WHERE y = 1 AND p >= t / CAST(20 AS DOUBLE)) / CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE)
        + count(*) FILTER (WHERE y = 0 AND p < t / CAST(20 AS DOUBLE)) / CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE)) / 2 AS ba
FROM {models}, (SELECT unnest(generate_series(2, 18)) AS t) g GROUP BY model, model_order, t
"""
EXTRA["signal"] = """
SELECT *, CASE WHEN signal_a IS NULL THEN signal_b WHEN signal_b IS NULL THEN signal_a ELSE (signal_a + signal_b) / 2 END AS signal FROM {scores}
"""
EXTRA["rule_fit"] = """
SELECT threshold, direction, greatest(stddev_pop(coalesce(signal, threshold)), 1) AS scale
FROM (SELECT *, (m1 + m0) / 2 AS threshold, CASE WHEN m1 >= m0 THEN 1 ELSE -1 END AS direction
      FROM (SELECT median(signal) FILTER (WHERE y = 1) AS m1, median(signal) FILTER (WHERE y = 0) AS m0 FROM {signal} WHERE split = 'train') a,
           (SELECT signal FROM {signal} WHERE split = 'train') b) c
GROUP BY threshold, direction
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scores")


@query(
    "metrics_by_split",
    "A-50",
    _derived_sql(f"SELECT split, {_CONF} FROM {{scores}} GROUP BY split", "split"),
    EXTRA,
)
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.metrics_by(scores(spark, sf_dir), ["split"], T))


@query(
    "metrics_by_slice",
    "A-54",
    _derived_sql(
        f"""SELECT 'family' AS slice, workload_family AS slice_value, {_CONF} FROM {{scores}} GROUP BY workload_family
            UNION ALL SELECT 'session', experiment_session_id, {_CONF} FROM {{scores}} GROUP BY experiment_session_id
            UNION ALL SELECT 'overall', 'all', {_CONF} FROM {{scores}}""",
        "slice, slice_value",
    ),
    EXTRA,
)
def metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.metrics_by_slices(scores(spark, sf_dir), T))


@query(
    "rank_metrics",
    "A-51 A-52",
    f"""SELECT split, {r_sql("(sum(pos * ((n - fp) + neg / CAST(2 AS DOUBLE))) / (max(np) * CAST(max(n) AS DOUBLE)))")} AS auroc,
               {r_sql("(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(np))")} AS auprc
        FROM (SELECT *, sum(pos) OVER (PARTITION BY split) AS np, sum(neg) OVER (PARTITION BY split) AS n FROM {{cumulated}}) c GROUP BY split""",
    EXTRA,
)
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.rank_metrics(scores(spark, sf_dir), ["split"]))


@query(
    "brier_score",
    "A-53",
    f"SELECT split, {r_sql('avg((p - y) * (p - y))')} AS brier_score FROM {{scores}} GROUP BY split",
    EXTRA,
)
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.brier(scores(spark, sf_dir), ["split"]))


@query(
    "run_predictions",
    "A-55 A-56",
    f"""SELECT run_id, y AS target, CAST(p >= 0.35 AS INT) AS predicted, {r_sql("p")} AS score, p BETWEEN CAST(0.25 AS DOUBLE) AND CAST(0.45 AS DOUBLE) AS abstained FROM {{by_run_exact}}""",
    EXTRA,
)
def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.run_predictions(scores(spark, sf_dir), T))


@query(
    "run_level_metrics",
    "A-55",
    _derived_sql(f"SELECT 'run' AS unit, {_CONF} FROM {{by_run}}", "unit"),
    EXTRA,
)
def run_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = M.run_scores(scores(spark, sf_dir)).withColumn("unit", F.lit("run"))
    return round_doubles(M.metrics_by(runs, ["unit"], T))


@query(
    "abstention_by_split",
    "A-56",
    f"""SELECT split, decided, {r_sql("(decided / CAST(n AS DOUBLE))")} AS coverage, {r_sql("(1 - decided / CAST(n AS DOUBLE))")} AS abstention_rate,
               {r_sql("(wrong / nullif(CAST(decided AS DOUBLE), 0))")} AS selective_risk
        FROM (SELECT split, count(*) AS n, count(*) FILTER (WHERE d) AS decided, count(*) FILTER (WHERE d AND CAST(p >= 0.35 AS INT) <> y) AS wrong
              FROM (SELECT *, p < CAST(0.35 AS DOUBLE) - CAST(0.1 AS DOUBLE) OR p > CAST(0.35 AS DOUBLE) + CAST(0.1 AS DOUBLE) AS d FROM {{scores}}) q GROUP BY split) z""",
    EXTRA,
)
def abstention_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.abstention(scores(spark, sf_dir), ["split"], T))


@query(
    "bootstrap_interval",
    "A-57",
    f"""SELECT CAST(CASE WHEN (SELECT count(*) FROM {{outcomes}}) >= 20 THEN 500 ELSE 0 END AS BIGINT) AS repetitions, m AS usable_repetitions, {r_sql("s[greatest(1, CAST(floor(m * CAST(0.025 AS DOUBLE)) AS BIGINT))]")} AS ci_low,
               {r_sql("s[least(m, CAST(floor(m * CAST(0.975 AS DOUBLE)) AS BIGINT) + 1)]")} AS ci_high,
               {r_sql("list_median(s)")} AS median, (SELECT count(*) FROM {{outcomes}}) AS independent_group_count FROM {{boot}}""",
    EXTRA,
)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = M.run_predictions(scores(spark, sf_dir), T)
    return round_doubles(M.bootstrap_balanced_accuracy(predictions))


_MULTI = """
SELECT l.label, count(*) FILTER (WHERE s.target_label = l.label) AS support,
       count(*) FILTER (WHERE s.target_label = l.label AND s.predicted_label = l.label) AS hits,
       count(*) FILTER (WHERE s.predicted_label = l.label) AS claimed
FROM (VALUES ('training'), ('inference'), ('control')) l(label), {scores} s GROUP BY l.label
"""
EXTRA["multi"] = _MULTI


@query(
    "multiclass_confusion",
    "A-58",
    "SELECT target_label, predicted_label, count(*) AS n FROM {scores} GROUP BY target_label, predicted_label",
    EXTRA,
)
def multiclass_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.multiclass_cells(scores(spark, sf_dir))


@query(
    "multiclass_metrics",
    "A-58",
    f"""SELECT label, support, {r_sql("(coalesce(hits / nullif(CAST(claimed AS DOUBLE), 0), 0))")} AS precision,
               {r_sql("(coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0))")} AS recall,
               {r_sql("(coalesce(2 * hits / nullif(CAST(support + claimed AS DOUBLE), 0), 0))")} AS f1 FROM {{multi}}""",
    EXTRA,
)
def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.multiclass_metrics(scores(spark, sf_dir), TARGET_LABELS))


@query(
    "multiclass_macro",
    "A-58",
    f"""SELECT {r_sql("avg(hits / CAST(claimed AS DOUBLE))")} AS macro_precision, {r_sql("avg(hits / CAST(support AS DOUBLE))")} AS macro_recall,
               {r_sql("avg(2 * hits / CAST(support + claimed AS DOUBLE))")} AS macro_f1, {r_sql("avg(hits / CAST(support AS DOUBLE))")} AS balanced_accuracy
        FROM {{multi}}""",
    EXTRA,
)
def multiclass_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.macro(M.multiclass_metrics(scores(spark, sf_dir), TARGET_LABELS)))


def _outcome_sql(keys: str) -> str:
    return f"""SELECT {keys}, CASE WHEN mixed THEN 'invalid_mixed_target_family' ELSE 'evaluated' END AS status, window_count, run_count,
       {r_sql("score_mean")} AS score_mean, {r_sql("score_median")} AS score_median,
       {r_sql("(CASE WHEN NOT mixed AND label = 'training' THEN error END)")} AS evasion_rate,
       {r_sql("(CASE WHEN NOT mixed AND label <> 'training' THEN error END)")} AS false_positive_rate,
       {r_sql("(CASE WHEN NOT mixed AND label = 'training' THEN 1 - error END)")} AS training_detection_rate,
       CASE WHEN score_mean >= 0.35 THEN 'training' ELSE 'nontraining' END AS predicted_label
FROM (SELECT {keys}, min(target_label) AS label, min(target_label) <> max(target_label) AS mixed, count(*) AS window_count,
             count(DISTINCT run_id) AS run_count, avg(p) AS score_mean, median(p) AS score_median,
             avg(CASE WHEN CAST(p >= 0.35 AS INT) <> CAST(target_label = 'training' AS INT) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS error
      FROM {{scores}} GROUP BY {keys}) q"""


@query("adversarial_outcomes", "A-59", _outcome_sql("workload_family"), EXTRA)
def adversarial_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.adversarial_outcome(scores(spark, sf_dir), ["workload_family"], T))


@query(
    "adversarial_outcomes_by_config", "A-59", _outcome_sql("workload_family, workload_config_id"), EXTRA
)
def adversarial_outcomes_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["workload_family", "workload_config_id"]
    return round_doubles(M.adversarial_outcome(scores(spark, sf_dir), keys, T))


@query(
    "hard_negative_rates",
    "A-61",
    f"""SELECT hard_negative, coalesce(count(*) FILTER (WHERE s.y = 0 AND s.p >= 0.35), 0) AS false_positives,
               count(*) FILTER (WHERE s.y = 0) AS sample_count,
               {r_sql("(count(*) FILTER (WHERE s.y = 0 AND s.p >= 0.35) / nullif(CAST(count(*) FILTER (WHERE s.y = 0) AS DOUBLE), 0))")} AS false_positive_rate
        FROM (VALUES ('host_transfer', 'control_host_transfer'), ('host_transfer', 'host_device_transfer'),
                     ('synchronized_inference', 'inference_synchronized'), ('synchronized_inference', 'synchronized_prefill')) a(hard_negative, workload_family)
        LEFT JOIN {{scores}} s USING (workload_family) GROUP BY hard_negative""",
    EXTRA,
)
def hard_negative_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_family = M.metrics_by(scores(spark, sf_dir), ["workload_family"], T)
    return round_doubles(M.hard_negative_rates(per_family))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    variants = F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.lit(i).alias("model_order"), s.alias("score"))
            for i, (n, s) in enumerate(
                {"majority": 0.25 + p / 2, "rule": p, "inverse": 1 - p}.items()
            )
        ]
    )
    rows = scores(spark, sf_dir).where("split = 'validation'").select("y", F.inline(variants))
    return rows.withColumnRenamed("score", "p")


@query(
    "validation_threshold_table",
    "A-62",
    f"SELECT model, model_order, threshold, {r_sql('ba')} AS balanced_accuracy FROM {{grid_table}}",
    EXTRA,
)
def validation_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.threshold_table(model_scores(spark, sf_dir), M.GRID))


@query(
    "model_selection",
    "T-03 T-04",
    f"""SELECT g.model, {r_sql("b.ba")} AS validation_score, g.threshold
        FROM (SELECT model, ba FROM {{grid_table}} WHERE threshold = 0.5 ORDER BY ba DESC, model_order LIMIT 1) b
        JOIN {{grid_table}} g ON g.model = b.model
        ORDER BY g.ba DESC, round(abs(g.threshold - 0.5), 9), g.threshold LIMIT 1""",
    EXTRA,
)
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.select_model_and_threshold(model_scores(spark, sf_dir)))


@query(
    "sample_counts",
    "A-63",
    """SELECT split, count(*) AS windows, count(DISTINCT run_id) AS runs, split = 'test' AND count(DISTINCT run_id) < 20 AS small_sample
       FROM {scores} GROUP BY split""",
    EXTRA,
)
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sample_counts(scores(spark, sf_dir))


@query(
    "majority_baseline",
    "M-01",
    "SELECT CASE WHEN sum(y) * 2 > count(*) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p FROM {scores} WHERE split = 'train'",
    EXTRA,
)
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.majority_probability(scores(spark, sf_dir).where("split = 'train'"))


SIGNALS = ("signal_a", "signal_b")


@query(
    "threshold_rule_fit",
    "M-06",
    f"SELECT {r_sql('threshold')} AS threshold, direction, {r_sql('scale')} AS scale FROM {{rule_fit}}",
    EXTRA,
)
def threshold_rule_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.fit_threshold_rule(scores(spark, sf_dir).where("split = 'train'"), SIGNALS))


@query(
    "threshold_rule_scores",
    "M-06 F-01",
    f"""SELECT run_id, split, predicted, count(*) AS n, {r_sql("sum(prob)")} AS score_sum, {r_sql("min(prob)")} AS score_min, {r_sql("max(prob)")} AS score_max
        FROM (SELECT s.run_id, s.split, CAST(direction * (coalesce(signal, threshold) - threshold) >= 0 AS INT) AS predicted,
                     1 / (1 + exp(-greatest(-60, least(60, direction * (coalesce(signal, threshold) - threshold) / scale)))) AS prob
              FROM {{signal}} s, {{rule_fit}} f) q GROUP BY run_id, split, predicted""",
    EXTRA,
)
def threshold_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).drop("p")
    rule = M.fit_threshold_rule(rows.where("split = 'train'"), SIGNALS)
    scored = M.apply_threshold_rule(rows, SIGNALS, rule)
    return round_doubles(
        scored.groupBy("run_id", "split", "predicted").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("p").alias("score_sum"),
            F.min("p").alias("score_min"),
            F.max("p").alias("score_max"),
        )
    )


@query(
    "train_medians",
    "M-02",
    f"""SELECT 'signal_a' AS column_name, count(signal_a) AS n, {r_sql("median(signal_a)")} AS median FROM {{scores}} WHERE split = 'train'
        UNION ALL SELECT 'signal_b', count(signal_b), {r_sql("median(signal_b)")} FROM {{scores}} WHERE split = 'train'""",
    EXTRA,
)
def train_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(M.train_medians(scores(spark, sf_dir).where("split = 'train'"), SIGNALS))
