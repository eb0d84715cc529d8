"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is
fine for a window, not for a sweep, family or run that may hold a third of the table.
Here a sketch only narrows the search: it brackets the wanted rank, values inside the
bracket and on either side of it are numbered, the values of the side that holds the rank are
counted, and the exact value is read off the counts. All heavy steps combine map-side,
and the counts are ordered in cells of the bracket; no group is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.segments import running_totals
from gaugeworks.session import cut_lineage

ACCURACY = 2000
# Rank error of the sketch is n / ACCURACY, more where many sketches are merged. A rank that is not
# in its bracket is counted on the side that holds it, so the margin decides the time alone.
MARGIN = 2.0 / ACCURACY
# Parts of a bracket that are ordered each on its own.
CELLS = 4096


def exact_quantiles(
    frame: DataFrame, keys: Sequence[str], value: Column, probabilities: dict[str, float]
) -> DataFrame:
    """One row per key with ``n`` and each named quantile, interpolated at (n - 1) * p."""
    keys = list(keys)
    rows = frame.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    names = list(probabilities)
    grid = [
        min(1.0, max(0.0, p + side * MARGIN)) for p in probabilities.values() for side in (-1, 1)
    ]
    sketch = rows.groupBy(*keys).agg(
        F.count("v").alias("n"), F.percentile_approx("v", grid, ACCURACY).alias("cuts")
    )
    brackets = sketch.select(
        *keys,
        "n",
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    ((F.col("n") - 1) * F.lit(float(p))).alias("position"),
                    F.col("cuts")[2 * i].alias("low"),
                    F.col("cuts")[2 * i + 1].alias("high"),
                )
                for i, (name, p) in enumerate(probabilities.items())
            ]
        ).alias("wanted"),
    )
    # A sketch depends on the order in which a shuffle delivers its parts, and the brackets are read
    # several times below: they are written once, so that every reader has the same ones.
    brackets = cut_lineage(brackets)
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    placed = rows.join(brackets, keys).select(*keys, "n", "v", F.inline("wanted")).withColumn("side", side)
    # A wanted rank lies on the side that the counts say, whatever the sketch took for its bracket.
    group = [*keys, "n", "name", "position"]
    sides = placed.groupBy(*group, "side").agg(
        F.count(F.lit(1)).alias("copies"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    below = Window.partitionBy(*keys, "name").orderBy("side").rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.col("before"), F.col("before") + F.col("copies") - 1
    low, high = F.floor("position"), F.ceil("position")
    chosen = (
        sides.withColumn("before", F.coalesce(F.sum("copies").over(below), F.lit(0)))
        .where(low.between(first, last) | high.between(first, last))
        .select(*keys, "name", "side", "before", "least", "most")
    )
    # Halves, so that no difference overflows; where an end is infinite all values share a cell.
    share = (F.col("v") / 2 - F.col("least") / 2) / F.nullif(F.col("most") / 2 - F.col("least") / 2, F.lit(0.0))
    cell = F.floor(F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0)) * CELLS)
    counted = (
        placed.join(chosen, [*keys, "name", "side"])
        .groupBy(*group, "side", "before", cell.alias("cell"), "v")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    ranked = running_totals(
        counted, [*keys, "name", "side"], ["v"], [F.col("cell")], {"rows": F.col("copies")}
    )
    first = F.col("before") + F.col("rows_before")
    last = first + F.col("copies") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(first, last), F.col("v")))

    picked = ranked.groupBy(*group).agg(at(low).alias("low"), at(high).alias("high"))
    fraction = F.col("position") - F.floor("position")
    result = F.col("low") * (1 - fraction) + F.col("high") * fraction
    return picked.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("name") == name, result)).alias(name) for name in names]
    )


def exact_median(frame: DataFrame, keys: Sequence[str], value: Column, name: str = "median") -> DataFrame:
    return exact_quantiles(frame, keys, value, {name: 0.5})


def median_and_mad(frame: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """``n``, median and median absolute deviation about it, per key."""
    keys = list(keys)
    rows = frame.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    middle = exact_median(rows, keys, F.col("v"))
    deviations = exact_median(
        rows.join(middle.drop("n"), keys), keys, F.abs(F.col("v") - F.col("median")), "mad"
    )
    return middle.join(deviations.drop("n"), keys)
