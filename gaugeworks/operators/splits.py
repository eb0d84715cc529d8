"""Leakage-free whole-run splits, folds and their audit.

Feature rows are first reduced to one identity row per run. Everything after that is
run-sized, and still free of single-task sorts: seeded orders use hash prefixes as
segments, and holdout plans are aggregates instead of run-by-value products.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.segments import row_numbers, running_totals
from gaugeworks.schemas import SPLITS

SEED = 20260730
# --- fixed values: identity of a run, and words that no model column may carry ---
IDENTITY = ("experiment_session_id", "target_label", "workload_family", "workload_config_id")
FORBIDDEN_TOKENS = ("run_id", "timestamp", "path", "filename", "label", "family", "session")
# ----------------------------------------------------------------------------------


def run_groups(rows: DataFrame) -> DataFrame:
    """One row per run with its identity and the list of identity violations.

    Fingerprint columns are never used for grouping. A conflict is seen as least and
    greatest value differing, which combines map-side where a distinct count would not.
    """
    spread = rows.groupBy("run_id").agg(
        *[F.min(c).alias(c) for c in IDENTITY],
        *[F.max(c).alias(f"max_{c}") for c in IDENTITY],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in IDENTITY],
        F.bool_or(F.coalesce("legacy_grouping_ambiguous", F.lit(False))).alias("ambiguous"),
        F.count(F.lit(1)).alias("window_count"),
    )
    problems = [F.when(F.col("ambiguous"), "ambiguous_legacy_grouping")]
    problems += [
        F.when(F.col(f"null_{c}") > 0, f"missing_{c}") for c in IDENTITY
    ]
    problems += [F.when(F.col(c) != F.col(f"max_{c}"), f"multiple_{c}") for c in IDENTITY]
    return spread.select(
        "run_id",
        *IDENTITY,
        "window_count",
        F.array_compact(F.array(*problems)).alias("violations"),
    )


def valid_groups(rows: DataFrame) -> DataFrame:
    return run_groups(rows).where(F.size("violations") == 0).drop("violations")


def seeded_hash(*parts: Column | str | int) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *texts), 256)


def seeded_position(frame: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Zero-based ``position`` of each row in hash order within ``keys``.

    The leading hex digits of the hash are the segments, so a stratum of any size is
    numbered in parallel pieces.
    """
    numbered = running_totals(
        frame,
        keys,
        [digest],
        [F.substring(digest, 1, 2), F.substring(digest, 1, 4)],
        {"rows": F.lit(1)},
    )
    return numbered.withColumnRenamed("rows_before", "position")


def check_fractions(test_fraction: float, validation_fraction: float) -> None:
    if not (0 < test_fraction < 1 and 0 < validation_fraction < 1):
        raise ValueError("split fractions must be in (0, 1)")
    if test_fraction + validation_fraction >= 1:
        raise ValueError(f"nothing is left to train on: {test_fraction} is for test, {validation_fraction} for validation")


def split_sizes(n: Column, test_fraction: float, validation_fraction: float) -> tuple[Column, Column]:
    """Test and validation counts of a stratum: banker's rounding, at least one each.

    If nothing would remain for training, validation shrinks first, then test.
    """
    test = F.greatest(F.lit(1), F.bround(n * F.lit(test_fraction), 0).cast("long"))
    validation = F.greatest(F.lit(1), F.bround(n * F.lit(validation_fraction), 0).cast("long"))
    excess = F.greatest(F.lit(0), test + validation - (n - 1))
    from_validation = F.least(excess, validation - 1)
    return (
        F.greatest(F.lit(1), test - (excess - from_validation)),
        validation - from_validation,
    )


def stratified_split(
    groups: DataFrame,
    required_families: Sequence[str] = (),
    seed: int = SEED,
    test_fraction: float = 0.2,
    validation_fraction: float = 0.2,
) -> DataFrame:
    """Whole-run split per stratum: required families on their own, the rest by class.

    A stratum of fewer than three runs gets split null and is reported by validation.
    """
    check_fractions(test_fraction, validation_fraction)
    stratum = F.when(
        F.col("workload_family").isin(*required_families) if required_families else F.lit(False),
        F.concat(F.lit("family:"), "workload_family"),
    ).otherwise(F.concat(F.lit("class:"), "target_label"))
    marked = groups.withColumn("stratum", stratum).withColumn(
        "_digest", seeded_hash(seed, F.col("stratum"), F.col("run_id"))
    )
    sizes = marked.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_runs"))
    placed = seeded_position(marked, ["stratum"], "_digest").join(sizes, "stratum")
    test, validation = split_sizes(F.col("stratum_runs"), test_fraction, validation_fraction)
    return placed.withColumn(
        "split",
        F.when(
            F.col("stratum_runs") >= 3,
            F.when(F.col("position") < test, "test")
            .when(F.col("position") < test + validation, "validation")
            .otherwise("train"),
        ),
    ).drop("_digest")


def session_holdout(
    groups: DataFrame, required_families: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """One row: the test and validation session, or nulls when no pair is feasible.

    A session can be held out if it shows every class and required family. Two such
    sessions leave a complete training part exactly when every class and required
    family occurs in at least three sessions, so no pair has to be enumerated.
    """
    required = F.when(
        F.col("workload_family").isin(*required_families) if required_families else F.lit(False),
        F.col("workload_family"),
    )
    tags = groups.select(
        "experiment_session_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("class:"), "target_label"), F.concat(F.lit("family:"), required)
                )
            )
        ).alias("tag"),
    ).distinct()
    per_tag = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("sessions"))
    need = per_tag.agg(
        F.count(F.lit(1)).alias("tags"),
        F.min("sessions").alias("rarest"),
        F.count_if(F.col("tag").startswith("family:")).alias("families"),
    )
    per_session = tags.groupBy("experiment_session_id").agg(F.count(F.lit(1)).alias("own_tags"))
    # ``need`` is one row whatever the data size, so this product adds columns, not rows.
    complete = per_session.join(F.broadcast(need), F.col("own_tags") == F.col("tags")).where(
        (F.col("rarest") >= 3) & (F.col("families") == len(set(required_families)))
    )
    session = F.col("experiment_session_id")
    as_test, as_validation = seeded_hash(seed, "test", session), seeded_hash(seed, "validation", session)
    first = F.min(F.struct(as_test.alias("h"), session.alias("s")))
    leaders = complete.agg(first.alias("test"))
    second = complete.join(F.broadcast(leaders), session != F.col("test.s")).agg(
        F.min(F.struct(as_validation.alias("h"), session.alias("s"))).alias("v")
    )
    return leaders.select(F.col("test.s").alias("test_session"), F.lit(1).alias("_one")).join(
        F.broadcast(second.select(F.col("v.s").alias("validation_session"), F.lit(1).alias("_one"))),
        "_one",
    ).select(
        F.when(F.col("validation_session").isNotNull(), F.col("test_session")).alias("test_session"),
        "validation_session",
    )


def session_split(groups: DataFrame, test_session: str, validation_session: str) -> DataFrame:
    session = F.col("experiment_session_id")
    return groups.withColumn(
        "split",
        F.when(session == test_session, "test")
        .when(session == validation_session, "validation")
        .otherwise("train"),
    )


def holdout_split(groups: DataFrame, field: str, value: str, seed: int = SEED) -> DataFrame:
    """Runs with ``field == value`` are the test set; one validation run per label if two remain."""
    if field not in ("workload_family", "workload_config_id"):
        raise ValueError("holdouts are by workload_family or workload_config_id")
    held = F.col(field) == value
    digest = seeded_hash(seed, field, F.col("target_label"), F.col("run_id"))
    best = (
        groups.where(~held)
        .groupBy("target_label")
        .agg(F.min_by("run_id", digest).alias("_pick"), F.count(F.lit(1)).alias("_n"))
    )
    return (
        groups.join(F.broadcast(best), "target_label", "left")
        .withColumn(
            "split",
            F.when(held, "test")
            .when((F.col("_n") >= 2) & (F.col("run_id") == F.col("_pick")), "validation")
            .otherwise("train"),
        )
        .drop("_pick", "_n")
    )


def holdout_sweep(groups: DataFrame, field: str, seed: int = SEED) -> DataFrame:
    """The holdout of every value of ``field`` at once, as one row per (value, label).

    The validation run of a label is its first run in hash order outside the held-out
    value: the label's best run, or its best run of any other value if that one is held.
    """
    digest = seeded_hash(seed, field, F.col("target_label"), F.col("run_id"))
    pick = F.struct(digest.alias("h"), F.col("run_id").alias("run"))
    cells = groups.groupBy("target_label", field).agg(
        F.count(F.lit(1)).alias("runs"), F.min(pick).alias("best")
    )
    labels = cells.groupBy("target_label").agg(
        F.sum("runs").alias("label_runs"),
        F.min(F.struct("best", F.col(field).alias("value"))).alias("one"),
    )
    with_one = cells.join(labels, "target_label")
    two = (
        with_one.where(F.col(field) != F.col("one.value"))
        .groupBy("target_label")
        .agg(F.min("best").alias("two"))
    )
    values = groups.select(field).distinct()
    # One row per distinct label: a fixed set of classes.
    table = labels.join(two, "target_label", "left").select(
        F.collect_list(F.struct("target_label", "label_runs", "one", "two")).alias("t")
    )
    own = cells.select(field, "target_label", F.col("runs").alias("held_runs"))
    expanded = values.join(F.broadcast(table), F.lit(True)).select(field, F.inline("t"))
    joined = expanded.join(own, [field, "target_label"], "left").fillna(0, ["held_runs"])
    remaining = F.col("label_runs") - F.col("held_runs")
    chosen = F.when(F.col("one.value") != F.col(field), F.col("one.best.run")).otherwise(
        F.col("two.run")
    )
    validation = F.when(remaining >= 2, chosen)
    return joined.select(
        F.lit(field).alias("holdout_field"),
        F.col(field).alias("holdout_value"),
        "target_label",
        F.col("held_runs").alias("test_runs"),
        validation.alias("validation_run_id"),
        (remaining - validation.isNotNull().cast("long")).alias("train_runs"),
    )


def group_kfold(groups: DataFrame, group_field: str = "run_id", n_splits: int = 5) -> DataFrame:
    """Test fold of every run: position of its group in sorted order, modulo ``n_splits``."""
    if group_field not in ("run_id", "experiment_session_id", "workload_family"):
        raise ValueError("unsupported group field")
    if n_splits < 2:
        raise ValueError("at least two folds are required")
    folds = leave_one_group_out(groups, group_field).withColumn(
        "test_fold", F.pmod(F.col("test_fold"), F.lit(n_splits))
    )
    return folds


def leave_one_group_out(groups: DataFrame, group_field: str) -> DataFrame:
    """Test fold of every run when each group is a fold of its own, folds in sorted group order."""
    keyed = groups.withColumn("_group", F.col(group_field).cast("string"))
    names = keyed.select("_group").distinct()
    numbered = row_numbers(names, ["_group"], "_fold")
    return keyed.join(numbered, "_group").select(
        "run_id", F.col("_group").alias("fold_group"), F.col("_fold").alias("test_fold")
    )


def fold_roles(folds: DataFrame, n_splits: int) -> DataFrame:
    """Every run in every fold with its role; the fold count is a parameter, not data."""
    fold = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))).alias("fold")
    return folds.select("run_id", "test_fold", fold).select(
        "run_id",
        "fold",
        F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train").alias("role"),
    )


def split_counts(assigned: DataFrame) -> DataFrame:
    """Run counts per split for class, family, configuration and session."""
    fields = ("target_label", "workload_family", "workload_config_id", "experiment_session_id")
    rows = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    )
    return (
        assigned.where("split IS NOT NULL")
        .select("split", F.inline(rows))
        .groupBy("split", "field", "value")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def split_problems(
    assigned: DataFrame, required_families: Sequence[str], diagnostic: bool = False
) -> DataFrame:
    """Missing (split, class) and (split, required family) cells, and runs left without a split.

    A diagnostic holdout treats the same rows as warnings.
    """
    spark = assigned.sparkSession
    splits = F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split")
    classes = assigned.select("target_label").distinct()
    expected = classes.select(F.lit("class").alias("kind"), F.col("target_label").alias("value"), splits)
    if required_families:
        families = spark.createDataFrame([(f,) for f in required_families], "value string")
        expected = expected.unionByName(families.select(F.lit("family").alias("kind"), "value", splits))
    present = assigned.select(
        "split",
        F.inline(
            F.array(
                F.struct(F.lit("class").alias("kind"), F.col("target_label").alias("value")),
                F.struct(F.lit("family").alias("kind"), F.col("workload_family").alias("value")),
            )
        ),
    ).distinct()
    missing = expected.join(present, ["split", "kind", "value"], "left_anti").select(
        F.concat(F.lit("missing_"), "kind").alias("problem"), "split", "value"
    )
    unplaced = assigned.where("split IS NULL").select(
        F.lit("stratum_too_small").alias("problem"), F.lit("").alias("split"), F.col("stratum").alias("value")
    ).distinct() if "stratum" in assigned.columns else None
    result = missing if unplaced is None else missing.unionByName(unplaced)
    return result.withColumn("severity", F.lit("warning" if diagnostic else "error"))


def choose_strategy(groups: DataFrame, required_families: Sequence[str], mode: str = "auto") -> tuple[str, DataFrame]:
    """Session holdout when feasible, otherwise the stratified whole-run split.

    Only the one-row feasibility result comes to the driver.
    """
    if mode not in ("auto", "session_holdout", "stratified_whole_run"):
        raise ValueError(f"unknown split mode {mode!r}")
    if mode != "stratified_whole_run":
        row = session_holdout(groups, required_families).first()
        if row is not None and row["test_session"] is not None:
            return "independent_session_holdout", session_split(
                groups, row["test_session"], row["validation_session"]
            )
        if mode == "session_holdout":
            raise ValueError("no session pair keeps every class and required family in each split")
    return "deterministic_class_stratified_whole_run", stratified_split(groups, required_families)


def audit_leakage(rows: DataFrame, feature_columns: Sequence[str], assignments: DataFrame) -> DataFrame:
    """One row: forbidden columns, runs in several splits or in none, unequal window lengths,
    ambiguous runs.

    ``assignments`` may hold more than one row per run; that is the leak looked for. Every run
    with rows must have exactly one split.
    """
    forbidden = sorted(
        c for c in feature_columns if any(token in c.lower() for token in FORBIDDEN_TOKENS)
    )
    leaks = (
        assignments.groupBy("run_id")
        .agg((F.min("split") != F.max("split")).alias("leak"))
        .agg(F.count_if("leak").alias("split_leak_runs"))
    )
    placed = assignments.where("split IS NOT NULL").select("run_id").distinct()
    unplaced = rows.select("run_id").distinct().join(placed, "run_id", "left_anti").agg(
        F.count(F.lit(1)).alias("runs_without_split")
    )
    # Distinct (label, length) cells are few; only those are gathered.
    lengths = (
        rows.select("target_label", "window_seconds")
        .distinct()
        .groupBy("target_label")
        .agg(F.array_sort(F.collect_list("window_seconds")).alias("lengths"))
        .agg((F.count_distinct("lengths") > 1).alias("class_specific_window_lengths"))
    )
    ambiguous = (
        rows.groupBy("run_id")
        .agg(
            F.bool_or(
                F.coalesce("legacy_grouping_ambiguous", F.lit(False))
                | F.coalesce(F.col("experiment_session_id") == "", F.lit(True))
            ).alias("bad")
        )
        .agg(F.count_if("bad").alias("ambiguous_runs"))
    )
    one = F.lit(1).alias("_one")
    joined = leaks.select("*", one).join(lengths.select("*", one), "_one").join(
        ambiguous.select("*", one), "_one"
    ).join(unplaced.select("*", one), "_one")
    clean = (
        (F.lit(len(forbidden)) == 0)
        & (F.col("split_leak_runs") == 0)
        & (F.col("runs_without_split") == 0)
        & ~F.col("class_specific_window_lengths")
        & (F.col("ambiguous_runs") == 0)
    )
    return joined.select(
        F.lit(",".join(forbidden)).alias("forbidden_columns"),
        "split_leak_runs",
        "runs_without_split",
        "class_specific_window_lengths",
        "ambiguous_runs",
        clean.alias("passed"),
    )
