"""Exact detector metrics over a table of scores (y in {0, 1}, p in [0, 1]).

Confusion counts combine map-side. Rank metrics first collapse equal scores, then add
up counts along the score axis piecewise, so neither ties nor sheer size meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.quantiles import exact_median, exact_quantiles
from gaugeworks.functions.segments import range_totals
from gaugeworks.operators.splits import SEED

GRID = tuple(step / 20 for step in range(2, 19))
HARD_NEGATIVES = {
    "host_transfer": ("control_host_transfer", "host_device_transfer"),
    "synchronized_inference": ("inference_synchronized", "synchronized_prefill"),
}


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def confusion(threshold: Column | float) -> list[Column]:
    """Aggregates tp, fp, fn, tn for a prediction p >= threshold."""
    hit = F.col("p") >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    positive = F.col("y") == 1
    return [
        F.count_if(positive & hit).alias("tp"),
        F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"),
        F.count_if(~positive & ~hit).alias("tn"),
    ]


def derived(frame: DataFrame) -> DataFrame:
    """Metrics from tp, fp, fn, tn. Undefined rates are null; precision, recall and F1 fall to 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    both = (tp + fn > 0) & (tn + fp > 0)
    zero = F.lit(0.0)
    return frame.withColumns(
        {
            "sample_count": tp + fp + fn + tn,
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "balanced_accuracy": F.when(both, (recall + specificity) / 2),
            "precision": F.coalesce(ratio(tp, tp + fp), zero),
            "recall": F.coalesce(recall, zero),
            "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
            "training_recall": recall,
            "inference_recall": specificity,
            "false_positive_rate": ratio(fp, fp + tn),
            "false_negative_rate": ratio(fn, fn + tp),
            "nontraining_precision": ratio(tn, tn + fn),
            "training_precision": ratio(tp, tp + fp),
            "one_class": ~both,
        }
    )


def metrics_by(scores: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    return derived(scores.groupBy(*keys).agg(*confusion(threshold)))


def metrics_by_slices(scores: DataFrame, threshold: float) -> DataFrame:
    """Overall, per-family and per-session metrics in one pass with GROUPING SETS."""
    family, session = "workload_family", "experiment_session_id"
    grouped = scores.groupingSets([[family], [session], []], family, session).agg(
        F.grouping_id().alias("gid"), *confusion(threshold)
    )
    kind = F.when(F.col("gid") == 1, "family").when(F.col("gid") == 2, "session").otherwise("overall")
    return derived(
        grouped.select(
            kind.alias("slice"),
            F.coalesce(family, session, F.lit("all")).alias("slice_value"),
            "tp",
            "fp",
            "fn",
            "tn",
        )
    )


def rank_metrics(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUROC with averaged ties and average precision with ties grouped; null for one class."""
    keys = list(keys)
    levels = scores.groupBy(*keys, "p").agg(
        F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg")
    )
    counted = range_totals(
        levels, keys, [F.col("p").desc()], {"pos": F.col("pos"), "neg": F.col("neg")}
    )
    # Area in units of positive-negative pairs: every positive beats the negatives below it.
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    sums = counted.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("lost"),
        F.sum(F.col("pos") * (tp / F.nullif(tp + fp, F.lit(0)))).alias("precision_sum"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(
        *keys,
        F.when(both, 1 - F.col("lost") / F.nullif(pairs, F.lit(0.0))).alias("auroc"),
        F.when(both, F.col("precision_sum") / F.nullif("positives", F.lit(0))).alias("auprc"),
    )


def brier(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    error = F.col("p") - F.col("y")
    return scores.groupBy(*keys).agg(F.avg(error * error).alias("brier_score"))


#: Scores are added up in whole parts of one, so a mean is the same in any order of the rows.
SCORE_PARTS = 1_000_000_000


def run_scores(scores: DataFrame) -> DataFrame:
    """Mean score, to a billionth of each score, and target per run."""
    parts = F.sum(F.round(F.col("p") * float(SCORE_PARTS)).cast("long"))
    mean = parts.cast("double") / (F.count("p") * float(SCORE_PARTS))
    return scores.groupBy("run_id").agg(mean.alias("p"), F.max("y").alias("y"))


def run_predictions(scores: DataFrame, threshold: float, margin: float = 0.1) -> DataFrame:
    """Run-level prediction; a run abstains inside the closed band around the threshold."""
    low, high = (round(end, 12) for end in (max(0.0, threshold - margin), min(1.0, threshold + margin)))
    return run_scores(scores).select(
        "run_id",
        F.col("y").alias("target"),
        (F.col("p") >= threshold).cast("int").alias("predicted"),
        F.col("p").alias("score"),
        F.col("p").between(low, high).alias("abstained"),
    )


def abstention(scores: DataFrame, keys: Sequence[str], threshold: float, margin: float = 0.1) -> DataFrame:
    """Coverage and risk when scores inside the band are left undecided (decided strictly outside)."""
    low, high = max(0.0, threshold - margin), min(1.0, threshold + margin)
    decided = (F.col("p") < low) | (F.col("p") > high)
    wrong = (F.col("p") >= threshold).cast("int") != F.col("y")
    counts = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(decided).alias("decided"),
        F.count_if(decided & wrong).alias("wrong"),
    )
    share = ratio(F.col("decided"), F.col("n"))
    return counts.select(
        *keys,
        "decided",
        share.alias("coverage"),
        (1 - share).alias("abstention_rate"),
        ratio(F.col("wrong"), F.col("decided")).alias("selective_risk"),
    )


def bootstrap_balanced_accuracy(
    predictions: DataFrame,
    repetitions: int = 500,
    minimum_runs: int = 20,
    seed: int = SEED,
    chunk: int = 4096,
) -> DataFrame:
    """Percentile interval of run-level balanced accuracy from whole-run resampling.

    A resample only matters through how many of its runs fall in each of the four
    outcome cells, so a draw is a number in [0, n) compared with the cells' cumulative
    sizes. No draw is joined to a run; repetitions spread over the cluster in chunks.
    """
    hit = F.col("target") == F.col("predicted")
    positive = F.col("target") == 1
    cells = predictions.agg(
        F.count_if(positive & hit).alias("c1"),
        F.count_if(positive & ~hit).alias("c2"),
        F.count_if(~positive & hit).alias("c3"),
        F.count(F.lit(1)).alias("n"),
    )
    spark = predictions.sparkSession
    reps = spark.range(1, repetitions + 1).withColumnRenamed("id", "rep")
    # ``cells`` is a single row.
    plan = reps.join(F.broadcast(cells), F.lit(True)).where(F.col("n") >= minimum_runs)
    chunks = plan.withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))
    ).repartition("rep", "start")
    draws = chunks.withColumn(
        "draw", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + chunk - 1, F.col("n") - 1)))
    )
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("rep"), F.col("draw")), 256)
    at = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("n"))
    first, second, third = F.col("c1"), F.col("c1") + F.col("c2"), F.col("c1") + F.col("c2") + F.col("c3")
    drawn = draws.withColumn("at", at).groupBy("rep").agg(
        F.count_if(F.col("at") < first).alias("tp"),
        F.count_if((F.col("at") >= first) & (F.col("at") < second)).alias("fn"),
        F.count_if((F.col("at") >= second) & (F.col("at") < third)).alias("tn"),
        F.count_if(F.col("at") >= third).alias("fp"),
    )
    score = (
        ratio(F.col("tp"), F.col("tp") + F.col("fn")) + ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    ) / 2
    ordered = drawn.select(score.alias("s")).agg(
        F.array_sort(F.collect_list("s")).alias("s"), F.count("s").alias("m")
    )
    low = F.greatest(F.lit(0), F.floor(F.col("m") * F.lit(0.025)) - 1).cast("int")
    high = F.least(F.col("m") - 1, F.floor(F.col("m") * F.lit(0.975))).cast("int")
    middle = (F.get("s", F.floor((F.col("m") - 1) / 2).cast("int")) + F.get("s", F.ceil((F.col("m") - 1) / 2).cast("int"))) / 2
    one = F.lit(1).alias("_one")
    return (
        cells.select(F.col("n").alias("independent_group_count"), one)
        .join(ordered.select("s", "m", one), "_one", "left")
        .select(
            F.when(F.col("independent_group_count") >= minimum_runs, repetitions)
            .otherwise(0)
            .cast("long")
            .alias("repetitions"),
            F.col("m").alias("usable_repetitions"),
            F.when(F.col("m") > 0, F.get("s", low)).alias("ci_low"),
            F.when(F.col("m") > 0, F.get("s", high)).alias("ci_high"),
            F.when(F.col("m") > 0, middle).alias("median"),
            "independent_group_count",
        )
    )


def multiclass_cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("target_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def multiclass_metrics(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per label; zero where undefined."""
    spark = rows.sparkSession
    cells = multiclass_cells(rows)
    truth = cells.groupBy(F.col("target_label").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("target_label") == F.col("predicted_label"), F.col("n"))).alias("hits"),
    )
    predicted = cells.groupBy(F.col("predicted_label").alias("label")).agg(F.sum("n").alias("claimed"))
    wanted = spark.createDataFrame([(x,) for x in labels], "label string")
    joined = wanted.join(truth, "label", "left").join(predicted, "label", "left").fillna(
        0, ["support", "hits", "claimed"]
    )
    zero = F.lit(0.0)
    return joined.select(
        "label",
        "support",
        F.coalesce(ratio(F.col("hits"), F.col("claimed")), zero).alias("precision"),
        F.coalesce(ratio(F.col("hits"), F.col("support")), zero).alias("recall"),
        F.coalesce(ratio(2 * F.col("hits"), F.col("support") + F.col("claimed")), zero).alias("f1"),
    )


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def adversarial_outcome(scores: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Error rates of families with one target label: evasion for training, else false positives."""
    keys = list(keys)
    expected = (F.col("target_label") == "training").cast("int")
    wrong = (F.col("p") >= threshold).cast("int") != expected
    sums = scores.groupBy(*keys).agg(
        F.min("target_label").alias("target_label"),
        (F.min("target_label") != F.max("target_label")).alias("mixed"),
        F.count(F.lit(1)).alias("window_count"),
        F.count_distinct("run_id").alias("run_count"),
        F.avg("p").alias("score_mean"),
        F.avg(wrong.cast("double")).alias("error"),
    )
    middle = exact_median(scores, keys, F.col("p"), "score_median").drop("n")
    training = F.col("target_label") == "training"
    return sums.join(middle, keys).select(
        *keys,
        F.when(F.col("mixed"), "invalid_mixed_target_family").otherwise("evaluated").alias("status"),
        "window_count",
        "run_count",
        "score_mean",
        "score_median",
        F.when(~F.col("mixed") & training, F.col("error")).alias("evasion_rate"),
        F.when(~F.col("mixed") & ~training, F.col("error")).alias("false_positive_rate"),
        F.when(~F.col("mixed") & training, 1 - F.col("error")).alias("training_detection_rate"),
        F.when(F.col("score_mean") >= threshold, "training").otherwise("nontraining").alias("predicted_label"),
    )


def hard_negative_rates(per_family: DataFrame) -> DataFrame:
    """False positive rate per hard-negative name, summing its aliases; zero rows stay visible."""
    aliases = per_family.sparkSession.createDataFrame(
        [(n, f) for n, families in HARD_NEGATIVES.items() for f in families],
        "hard_negative string, workload_family string",
    )
    return (
        aliases.join(per_family.select("workload_family", "fp", "tn"), "workload_family", "left")
        .groupBy("hard_negative")
        .agg(
            F.coalesce(F.sum("fp"), F.lit(0)).alias("false_positives"),
            F.coalesce(F.sum(F.col("fp") + F.col("tn")), F.lit(0)).alias("sample_count"),
        )
        .withColumn("false_positive_rate", ratio(F.col("false_positives"), F.col("sample_count")))
    )


def threshold_table(scores: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Balanced accuracy of every (model, threshold) in one pass over the scores.

    Every threshold is an array slot, not a copy of the rows.
    """
    positive = F.col("y") == 1
    aggregates = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            (
                ratio(F.count_if(positive & (F.col("p") >= t)), F.count_if(positive))
                + ratio(F.count_if(~positive & (F.col("p") < t)), F.count_if(~positive))
            ).alias("twice"),
        ).alias(f"t{i}")
        for i, t in enumerate(thresholds)
    ]
    wide = scores.groupBy("model", "model_order").agg(*aggregates)
    return wide.select(
        "model", "model_order", F.inline(F.array(*[f"t{i}" for i in range(len(thresholds))]))
    ).select("model", "model_order", "threshold", (F.col("twice") / 2).alias("balanced_accuracy"))


def select_model_and_threshold(scores: DataFrame) -> DataFrame:
    """Best model at 0.5 (ties: earlier model), then its best grid threshold (nearest 0.5, lower).

    Takes validation scores only. One row; models and grid are small by construction.
    """
    table = threshold_table(scores, GRID)
    at_half = table.where(F.col("threshold") == 0.5)
    model = at_half.agg(
        F.max_by(
            F.struct("model", F.col("balanced_accuracy").alias("score")),
            F.struct("balanced_accuracy", -F.col("model_order")),
        ).alias("m")
    ).select(F.col("m.model").alias("model"), F.col("m.score").alias("validation_score"))
    chosen = table.join(F.broadcast(model), "model")
    return chosen.groupBy("model", "validation_score").agg(
        F.max_by(
            "threshold",
            F.struct("balanced_accuracy", -F.round(F.abs(F.col("threshold") - 0.5), 9), -F.col("threshold")),
        ).alias("threshold")
    )


def sample_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("run_id").alias("runs")
    ).withColumn("small_sample", (F.col("split") == "test") & (F.col("runs") < 20))


def majority_probability(train: DataFrame) -> DataFrame:
    """Constant score of the majority baseline: 1 if positives outnumber negatives, else 0."""
    return train.agg(
        F.when(F.sum(F.col("y").cast("long")) * 2 > F.count(F.lit(1)), 1.0).otherwise(0.0).alias("p")
    )


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over columns, nulls ignored."""
    total = sum(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns)
    count = sum(F.col(f"`{c}`").isNotNull().cast("int") for c in columns)
    return total / F.nullif(count, F.lit(0))


def fit_threshold_rule(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: midpoint of the class medians of the row-mean signal, direction and scale."""
    signal = train.select("y", row_mean(columns).alias("signal"))
    medians = exact_median(signal, ["y"], F.col("signal"))
    rule = medians.agg(
        F.max(F.when(F.col("y") == 1, F.col("median"))).alias("training_median"),
        F.max(F.when(F.col("y") == 0, F.col("median"))).alias("other_median"),
    ).select(
        ((F.col("training_median") + F.col("other_median")) / 2).alias("threshold"),
        F.when(F.col("training_median") >= F.col("other_median"), 1).otherwise(-1).alias("direction"),
    )
    filled = signal.join(F.broadcast(rule), F.lit(True)).select(
        "threshold", "direction", F.coalesce("signal", "threshold").alias("signal")
    )
    return filled.groupBy("threshold", "direction").agg(
        F.greatest(F.stddev_pop("signal"), F.lit(1.0)).alias("scale")
    )


def stable_sigmoid(logit: Column) -> Column:
    """Logistic function with logits clipped to +-60."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))


def apply_threshold_rule(rows: DataFrame, columns: Sequence[str], rule: DataFrame) -> DataFrame:
    """Prediction and score of the rule; a missing signal sits on the threshold."""
    signal = F.coalesce(row_mean(columns), F.col("threshold"))
    offset = F.col("direction") * (signal - F.col("threshold"))
    return (
        rows.join(F.broadcast(rule), F.lit(True))
        .withColumn("predicted", (offset >= 0).cast("int"))
        .withColumn("p", stable_sigmoid(offset / F.col("scale")))
        .drop("threshold", "direction", "scale")
    )


def train_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per feature column as (column_name, median); all-missing columns drop out."""
    rows = train.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]
            )
        )
    )
    return exact_quantiles(rows, ["column_name"], F.col("v"), {"median": 0.5})
