"""The detector pipeline: gates stop it, and every table after the scores agrees with SQL over them."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import models as D
from gaugeworks.plans import evaluation as V

COLUMNS = ("gpu0__pcie_total_mean_bytes_per_s", "gpu0__pcie_total__communication_duty_cycle", "gpu0__power_draw_w__mean")
FAMILIES = ("f0", "f1", "f2", "f3")
MODELS = ("shallow_decision_tree",)


def feature_frame(spark, runs=48, families=4):
    rng = random.Random(6)
    rows = []
    for run in range(runs):
        family = run % families
        y = family % 2
        for _ in range(4):
            traffic = 1e6 * (1 + y) + rng.gauss(0, 9e5)
            power = None if rng.random() < 0.1 else rng.random() + 0.1 * y
            rows.append(
                (run, f"s{run // families % 3}", "training" if y else "inference", f"f{family}", f"c{run % 5}", 30.0, "benign", False, traffic, float(traffic > 1.6e6), power)
            )
    names = ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(
        rows,
        "run_id bigint, experiment_session_id string, target_label string, workload_family string, workload_config_id string,"
        f"window_seconds double, designation string, legacy_grouping_ambiguous boolean, {names}",
    )


def coverage_frame(spark, features, lacking=()):
    runs = features.select("run_id", "workload_family").distinct()
    return runs.select(
        "run_id",
        "workload_family",
        F.when(F.col("workload_family").isin(*lacking), "excluded").otherwise("included").alias("status"),
        F.when(F.col("workload_family").isin(*lacking), "short").alias("reason_code"),
        F.lit(3).alias("emitted_30"),
    )


@pytest.fixture(scope="module")
def evaluated(spark):
    features = feature_frame(spark)
    passed = spark.createDataFrame([(1, True)], "sweep_id int, capture_gate_passed boolean")
    return V.evaluate_detector(features, coverage_frame(spark, features), passed, COLUMNS, FAMILIES, 30.0, models=MODELS)


@pytest.fixture(scope="module")
def duck(evaluated, tmp_path_factory):
    connections = {}
    for name, tables in evaluated.items():
        path = str(tmp_path_factory.mktemp("scores") / "p")
        tables["scores"].write.parquet(path)
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW scores AS SELECT * FROM read_parquet('{path}/*.parquet')")
        connection.execute(CHOSEN)
        connections[name] = connection
    return connections


CHOSEN = """
CREATE VIEW grid AS SELECT round(0.1 + 0.05 * i, 2) AS threshold FROM range(17) t(i);
CREATE VIEW judged AS
  SELECT model, model_order, threshold,
         (count(*) FILTER (WHERE y = 1 AND p >= threshold) / count(*) FILTER (WHERE y = 1)
          + count(*) FILTER (WHERE y = 0 AND p < threshold) / count(*) FILTER (WHERE y = 0)) / 2 AS score
  FROM scores, grid WHERE split = 'validation' GROUP BY ALL;
CREATE VIEW best AS SELECT model, score FROM judged WHERE threshold = 0.5 ORDER BY score DESC, model_order LIMIT 1;
CREATE VIEW chosen AS SELECT j.model, b.score AS validation_score, j.threshold FROM judged j JOIN best b USING (model)
  ORDER BY j.score DESC, round(abs(threshold - 0.5), 9), threshold LIMIT 1;
CREATE VIEW test AS SELECT s.*, c.threshold FROM scores s JOIN chosen c USING (model) WHERE split = 'test';
CREATE VIEW runs AS SELECT run_id, avg(p) AS p, max(y) AS y, any_value(threshold) AS threshold FROM test GROUP BY run_id
"""

COUNTS = """count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE y = 0 AND p >= threshold) AS fp,
            count(*) FILTER (WHERE y = 1 AND p < threshold) AS fn, count(*) FILTER (WHERE y = 0 AND p < threshold) AS tn"""

AFTER_SCORES = {
    "selection": ("model validation_score threshold", "SELECT model, validation_score, threshold FROM chosen"),
    "candidates": (
        "model split tp fp fn tn",
        f"SELECT model, split, {COUNTS} FROM (SELECT *, 0.5 AS threshold FROM scores) GROUP BY model, split",
    ),
    "window_level": (
        "slice slice_value tp fp fn tn",
        f"""SELECT 'overall', 'all', {COUNTS} FROM test UNION ALL
            SELECT 'family', workload_family, {COUNTS} FROM test GROUP BY ALL UNION ALL
            SELECT 'session', experiment_session_id, {COUNTS} FROM test GROUP BY ALL""",
    ),
    "run_level": ("tp fp fn tn", f"SELECT {COUNTS} FROM runs"),
    "brier": ("split brier_score", "SELECT 'test', avg((p - y) * (p - y)) FROM test"),
    "rank_metrics": (
        "split auroc",
        """SELECT 'test', avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END)
           FROM test a JOIN test b ON a.y = 1 AND b.y = 0""",
    ),
    "abstention": (
        "split decided coverage abstention_rate selective_risk",
        """SELECT 'test', count(*) FILTER (WHERE d), count(*) FILTER (WHERE d) / count(*), 1 - count(*) FILTER (WHERE d) / count(*),
                  count(*) FILTER (WHERE d AND (p >= threshold) <> (y = 1)) / nullif(count(*) FILTER (WHERE d), 0)
           FROM (SELECT *, p < greatest(0, threshold - 0.1) OR p > least(1, threshold + 0.1) AS d FROM test)""",
    ),
    "run_predictions": (
        "run_id target predicted score abstained",
        """SELECT run_id, y, CAST(p >= threshold AS INT), p, p BETWEEN greatest(0, threshold - 0.1) AND least(1, threshold + 0.1) FROM runs""",
    ),
}


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("table", sorted(AFTER_SCORES))
def test_tables_agree_with_sql_over_the_scores(evaluated, duck, table):
    columns, sql = AFTER_SCORES[table]
    for name, tables in evaluated.items():
        found = [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in tables[table].select(*columns.split()).collect()]
        assert plain(found) == plain(duck[name].execute(sql).fetchall()), name


def test_every_feature_set_and_whole_runs(evaluated):
    assert set(evaluated) == {"communication_only", "auxiliary_only", "communication_plus_auxiliary"}
    scores = evaluated["communication_only"]["scores"]
    per_run = scores.groupBy("run_id").agg(F.count_distinct("split").alias("n"))
    assert per_run.where("n > 1").count() == 0
    families = scores.where("split = 'test'").select("workload_family").distinct().count()
    assert families == len(FAMILIES)


def test_gates_in_order(spark):
    features = feature_frame(spark, 24)
    coverage = coverage_frame(spark, features, lacking=("f2",))
    passed = spark.createDataFrame([(1, True)], "sweep_id int, capture_gate_passed boolean")
    closed = spark.createDataFrame([(1, True), (2, False)], "sweep_id int, capture_gate_passed boolean")
    with pytest.raises(V.GateError, match="calibration"):
        V.evaluate_detector(features, coverage, closed, COLUMNS, FAMILIES, 30.0)
    with pytest.raises(V.GateError, match="f2"):
        V.evaluate_detector(features, coverage, passed, COLUMNS, FAMILIES, 30.0)
    whole = coverage_frame(spark, features)
    with pytest.raises(V.GateError, match="leakage"):
        named = features.withColumn("target_label_hint_pcie_", F.lit(1.0))
        V.evaluate_detector(named, whole, passed, (*COLUMNS, "target_label_hint_pcie_"), FAMILIES, 30.0)
    with pytest.raises(V.GateError, match="auxiliary_only"):
        V.evaluate_detector(features, whole, passed, COLUMNS[:1], FAMILIES, 30.0)


def test_parts_need_their_classes():
    every = {(s, y): 3 for s in ("train", "validation", "test") for y in (0, 1)}
    assert V.missing_for_fit(every) is None and V.missing_for_fit(every, diagnostic=False) is None
    for part, name in (("train", "training"), ("validation", "validation")):
        assert name in V.missing_for_fit({k: n for k, n in every.items() if k != (part, 1)})
    no_test_class = {k: n for k, n in every.items() if k != ("test", 0)}
    assert V.missing_for_fit(no_test_class) is None
    assert "test" in V.missing_for_fit(no_test_class, diagnostic=False)
    assert "no rows in the validation and test part" == V.missing_for_fit({("train", 0): 1, ("train", 1): 1})


def test_medians_of_all_columns_at_once(spark):
    rng = random.Random(8)
    columns = [f"c{i}" for i in range(60)]
    rows = [tuple(None if rng.random() < 0.2 * (i % 5) else rng.choice([rng.random(), 1.0]) for i in range(60)) for _ in range(31)]
    frame = spark.createDataFrame([(*r, None) for r in rows], ", ".join(f"{c} double" for c in [*columns, "void"]))
    found = D.column_medians(frame, [*columns, "void"])
    for i, c in enumerate(columns):
        values = sorted(r[i] for r in rows if r[i] is not None)
        n = len(values)
        assert found[c] == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2), c
    assert "void" not in found


def test_window_lengths_and_their_choice(spark):
    features = feature_frame(spark, 24).withColumn("y", (F.col("target_label") == "training").cast("int"))
    split = F.element_at(F.array(*[F.lit(s) for s in ("train", "validation", "test")]), (F.floor(F.col("run_id") / 4) % 3 + 1).cast("int"))
    both = features.withColumn("split", split).unionByName(features.withColumn("split", split).withColumn("window_seconds", F.lit(5.0)))
    one_class = features.where("y = 1").withColumn("split", split).withColumn("window_seconds", F.lit(15.0))
    table = V.evaluate_by_window_length(both.unionByName(one_class), COLUMNS[:2], MODELS).collect()
    assert {(r.window_seconds, r.status) for r in table} == {(5.0, "evaluated_diagnostic"), (15.0, "insufficient_data"), (30.0, "evaluated_diagnostic")}
    for length in (5.0, 30.0):
        mine = [r for r in table if r.window_seconds == length]
        assert len(mine) == 2 * 4 and sum(r.selected for r in mine) == 2
