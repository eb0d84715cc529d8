"""Baseline detectors as pyspark.ml jobs, fitted on whole-run splits.

Preprocessing is learned on the training part only. Its columns travel as one vector, so a plan
has the same size for five columns or four hundred, and scoring is a single scan.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, StringIndexer, VarianceThresholdSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.groves import grown_and_scored
from gaugeworks.operators.metrics import (
    apply_threshold_rule,
    fit_threshold_rule,
    majority_probability,
)
from gaugeworks.plans.matrix import HoldoutPlan
from gaugeworks.session import cut_lineage

SEED = 20260730
MEAN_SIGNAL_MARKS = ("pcie_total_mean", "pcie_total__mean")
DUTY_MARK = "pcie_total__communication_duty_cycle"
ML_MODELS = ("logistic_regression", "shallow_decision_tree", "random_forest")


@dataclass(frozen=True)
class Preprocessing:
    """Medians, variance filter and scale learned on the training part."""

    columns: tuple[str, ...]
    candidates: tuple[str, ...]
    medians: tuple[float, ...]
    stages: PipelineModel
    dropped: tuple[str, ...]

    def filled(self, frame: DataFrame) -> DataFrame:
        """Adds ``_filled``: the candidate columns as a vector, medians for what is missing."""
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in self.candidates])
        whole = F.zip_with(values, F.lit(list(self.medians)), lambda v, m: F.coalesce(F.nanvl(v, F.lit(None)), m))
        return frame.withColumn("_filled", array_to_vector(whole))

    def apply(self, frame: DataFrame, scaled: bool) -> DataFrame:
        """Adds ``features``: imputed columns that vary, standardized if ``scaled``."""
        found = self.stages.transform(self.filled(frame))
        return found.withColumnRenamed("_scaled" if scaled else "_varied", "features").drop("_filled", "_varied", "_scaled")


#: Medians are exact up to half as many rows, and off by one of so many ranks beyond.
MEDIAN_RANKS = 10_000


def column_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of every column with a value, all columns in two passes that combine map-side.

    An even number of values has the mean of the two in the middle.
    """
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in columns]
    counts = train.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values)]).first()
    ranks = {
        i: [0.5] if n % 2 else [0.5, (n / 2 + 0.5) / n] for i, n in enumerate(counts) if n
    }
    if not ranks:
        return {}
    found = train.agg(
        *[F.percentile_approx(values[i], p, MEDIAN_RANKS).alias(f"q{i}") for i, p in ranks.items()]
    ).first()
    return {columns[i]: sum(found[f"q{i}"]) / len(p) for i, p in ranks.items()}


def fit_preprocessing(train: DataFrame, columns: Sequence[str]) -> Preprocessing:
    """Medians, then one pass each over the vectors for the variance filter and the scale.

    What reaches the driver is one row of as many numbers as there are columns. All-missing and
    constant columns are dropped.
    """
    medians = column_medians(train, columns)
    usable = [c for c in columns if c in medians]
    if not usable:
        raise ValueError("no candidate column has a value in the training part")
    plan = Preprocessing((), tuple(usable), tuple(medians[c] for c in usable), PipelineModel([]), ())
    vectors = cut_lineage(plan.filled(train).select("_filled"))
    selector = VarianceThresholdSelector(featuresCol="_filled", outputCol="_varied", varianceThreshold=0.0).fit(vectors)
    varied = [usable[i] for i in selector.selectedFeatures]
    if not varied:
        raise ValueError("no candidate column varies in the training part")
    scaler = StandardScaler(inputCol="_varied", outputCol="_scaled", withMean=True, withStd=True)
    stages = PipelineModel([selector, scaler.fit(selector.transform(vectors))])
    return replace(plan, columns=tuple(varied), stages=stages, dropped=tuple(sorted(set(columns) - set(varied))))


def class_weights(train: DataFrame, label: str) -> Column:
    """Balanced weights n / (classes * n_class) as an expression over ``label``."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError("the training part must contain at least two classes")
    total = sum(counts.values())
    expression = F.lit(None).cast("double")
    for value, n in counts.items():
        expression = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(expression)
    return expression


#: Spark grows no deeper tree than this; the forest has no other depth limit.
DEEPEST = 30
#: Candidate cuts per feature, and Newton steps of the logistic regression at most.
BINS = 256
ITERATIONS = 2000
#: Parts of a forest that grow side by side; their seeds are far apart, as Spark adds partition numbers to them.
GROVES = 12
SEED_STEP = 1_000_003
#: Numbers in a partition of a forest's rows: each partition has a histogram for every node that it meets.
PART_CELLS = 1 << 20
#: Bytes of coded rows (one a number), to fit and to score, that a task may hold: up to there trees grow inside tasks,
#: beyond it as jobs of Spark's forest, whose trees are all in the driver.
TASK_CELLS = 1 << 28


def estimator(
    name: str, total_weight: float, trees: int = 300, bins: int = BINS, iterations: int = ITERATIONS, rows: int = 0
):
    shared = {"featuresCol": "features", "labelCol": "y", "weightCol": "w", "probabilityCol": "probability"}
    if name == "logistic_regression":
        # The penalty of the summed loss at C = 1, for Spark's averaged loss; the scale of the columns
        # is that of a sample, so the weights are greater by the root of n / (n - 1).
        share = (rows - 1) / rows if rows > 1 else 1.0
        return LogisticRegression(
            maxIter=iterations, regParam=share / total_weight, elasticNetParam=0.0, standardization=False, **shared
        )
    if name == "shallow_decision_tree":
        return DecisionTreeClassifier(maxDepth=3, maxBins=bins, minInstancesPerNode=2, seed=SEED, **shared)
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=trees,
            maxDepth=DEEPEST,
            maxBins=bins,
            minInstancesPerNode=2,
            featureSubsetStrategy="sqrt",
            # Else every pass sends all trees to the tasks again.
            cacheNodeIds=True,
            seed=SEED,
            **shared,
        )
    raise ValueError(f"unknown model {name!r}")


def fit_forest(fitting: DataFrame, trees: int, rows: int, columns: int) -> list[RandomForestClassificationModel]:
    """A forest of ``trees`` trees as a list of smaller ones.

    Trees are independent of each other, but the passes of one fit follow one another and each is a
    short job, so parts of the forest are fitted side by side. Together they have all the trees.
    """
    fitting = fitting.coalesce(max(1, -(-rows * columns // PART_CELLS)))
    groves = min(GROVES, trees)

    def grow(i: int) -> RandomForestClassificationModel:
        own = trees // groves + (i < trees % groves)
        return estimator("random_forest", 1.0, own).setSeed(SEED + SEED_STEP * i).fit(fitting)

    with ThreadPool(groves) as pool:
        return pool.map(grow, range(groves))


def forest_score(rows: DataFrame, forest: Sequence[RandomForestClassificationModel]) -> DataFrame:
    """Adds ``p``: mean over all trees of the share of class 1 in the leaf, as one forest gives it."""
    total = F.lit(0.0)
    for i, grove in enumerate(forest):
        grove.setProbabilityCol(f"_p{i}").setRawPredictionCol("").setPredictionCol("")
        rows = grove.transform(rows)
        total = total + vector_to_array(f"_p{i}")[1] * grove.getNumTrees
    trees = sum(grove.getNumTrees for grove in forest)
    return rows.withColumn("p", total / trees).drop(*[f"_p{i}" for i in range(len(forest))])


def fit_and_score(
    train: DataFrame, rows: DataFrame, prepared: Preprocessing, name: str, trees: int = 300
) -> DataFrame:
    """Rows with score ``p`` of one model fitted on ``train`` (binary target ``y``)."""
    scaled = name == "logistic_regression"
    weighted = prepared.apply(train.withColumn("w", class_weights(train, "y")), scaled).select(
        "features", F.col("y").cast("double").alias("y"), "w"
    )
    fitting = cut_lineage(weighted)
    total, count = fitting.agg(F.sum("w"), F.count(F.lit(1))).first()
    if name == "random_forest":
        numbered = cut_lineage(prepared.apply(rows, scaled).withColumn("_id", F.monotonically_increasing_id()))
        if (count + numbered.count()) * len(prepared.columns) > TASK_CELLS:
            forest = fit_forest(fitting, trees, count, len(prepared.columns))
            return forest_score(numbered.drop("_id"), forest).drop("features")
        found = grown_and_scored(fitting, numbered.select("_id", "features"), len(prepared.columns), trees, DEEPEST, SEED)
        return numbered.drop("features").join(found, "_id").drop("_id")
    model = estimator(name, total, trees, rows=count).fit(fitting)
    if name == "logistic_regression" and model.summary.totalIterations >= ITERATIONS:
        warnings.warn(f"logistic regression stopped after {ITERATIONS} steps without converging", stacklevel=2)
    scored = model.transform(prepared.apply(rows, scaled))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def rule_columns(columns: Sequence[str], duty_cycle: bool) -> list[str]:
    if duty_cycle:
        found = [c for c in columns if DUTY_MARK in c]
    else:
        found = [c for c in columns if any(mark in c for mark in MEAN_SIGNAL_MARKS)]
    return found or list(columns[:1])


def score_candidates(
    frame: DataFrame,
    columns: Sequence[str],
    models: Sequence[str] = ML_MODELS,
    trees: int = 300,
    keep: Sequence[str] = ("run_id", "workload_family", "experiment_session_id", "split", "y"),
) -> DataFrame:
    """Long score table (model, model_order, keys, p) of validation and test rows.

    ``frame`` has ``split`` and ``y``. The candidates are the majority score, the ML
    models and two threshold rules, in the order in which ties are resolved.
    """
    # Fitting passes over the rows many times; they are computed once.
    frame = cut_lineage(frame.select(*dict.fromkeys([*keep, *columns])))
    train = frame.where("split = 'train'")
    rows = frame.where("split IN ('validation', 'test')")
    prepared = fit_preprocessing(train, columns)
    parts = [rows.join(F.broadcast(majority_probability(train)), F.lit(True)).withColumn("model", F.lit("majority"))]
    parts += [
        fit_and_score(train, rows, prepared, name, trees).withColumn("model", F.lit(name)) for name in models
    ]
    for name, duty in (("mean_communication_threshold", False), ("communication_duty_cycle_threshold", True)):
        selected = rule_columns(columns, duty)
        rule = fit_threshold_rule(train, selected)
        parts.append(apply_threshold_rule(rows, selected, rule).withColumn("model", F.lit(name)))
    table = None
    for order, part in enumerate(parts):
        piece = part.select("model", F.lit(order).alias("model_order"), *keep, "p")
        table = piece if table is None else table.unionByName(piece)
    return table


def multiclass_predictions(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Test rows with the label predicted by a shallow tree over three classes."""
    frame = cut_lineage(frame.drop("y"))
    train = frame.where("split = 'train'")
    rows = frame.where("split = 'test'")
    prepared = fit_preprocessing(train, columns)
    indexer = StringIndexer(inputCol="target_label", outputCol="y", stringOrderType="alphabetAsc").fit(train)
    weighted = prepared.apply(
        indexer.transform(train).withColumn("w", class_weights(train, "target_label")), False
    ).select("features", "y", "w")
    model = estimator("shallow_decision_tree", 1.0).fit(cut_lineage(weighted))
    scored = model.transform(prepared.apply(rows, False))
    names = F.array(*[F.lit(x) for x in indexer.labels])
    return scored.withColumn("predicted_label", F.get(names, F.col("prediction").cast("int"))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def score_adversarial(
    benign: DataFrame,
    adversarial: DataFrame,
    columns: Sequence[str],
    plan: HoldoutPlan,
    release_final: bool = False,
    trees: int = 300,
) -> DataFrame:
    """Adversarial rows scored by a forest fitted on benign training rows only.

    Final identities never enter the fit. A family with any sealed row is returned with
    null scores: it is not scored at all until released.
    """
    family, session, config = (
        F.col(c) for c in ("workload_family", "experiment_session_id", "workload_config_id")
    )
    train = cut_lineage(benign.where("split = 'train'").where(~plan.is_final(family, session, config)))
    rounds = adversarial.withColumn("round", plan.round_of(family, session, config, release_final))
    sealed = (
        rounds.where("round = 'sealed_final_holdout'").select("workload_family").distinct().withColumn("is_sealed", F.lit(True))
    )
    marked = rounds.join(sealed, "workload_family", "left")
    open_rows = marked.where("is_sealed IS NULL").drop("is_sealed")
    closed = marked.where("is_sealed").drop("is_sealed").withColumn("p", F.lit(None).cast("double"))
    scored = fit_and_score(train, open_rows, fit_preprocessing(train, columns), "random_forest", trees)
    return scored.unionByName(closed.select(*scored.columns))
