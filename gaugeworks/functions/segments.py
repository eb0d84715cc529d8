"""Ordered operations over keys of any size.

A window function over (key, order) sorts a whole key in one task. Here the order axis
is cut into segments first: each (key, segment) is handled on its own, and a small table
with one row per segment carries the state across the cuts. The results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.session import cut_lineage


def with_segment(frame: DataFrame, order: str, width: int) -> DataFrame:
    """Segment number of each row; ``order`` is a whole number, ``width`` its units per segment."""
    return frame.withColumn(
        "_segment",
        F.call_function("div", F.col(order) - F.pmod(F.col(order), F.lit(width)), F.lit(width)),
    )


def previous_row(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    width: int,
    prefix: str = "prev_",
) -> DataFrame:
    """Columns of the preceding row in (keys, order); null for the first row of a key."""
    keys, order = list(keys), list(order)
    cut = with_segment(frame, order[0], width)
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    carried = F.struct(*columns)
    tails = cut.groupBy(*keys, "_segment").agg(
        F.max_by(carried, F.struct(*order)).alias("_tail")
    )
    between = Window.partitionBy(*keys).orderBy("_segment")
    entries = tails.select(*keys, "_segment", F.lag("_tail").over(between).alias("_entry"))
    joined = cut.withColumn("_lag", F.lag(carried).over(inside)).join(
        entries, [*keys, "_segment"], "left"
    )
    source = F.when(F.col("_lag").isNotNull(), F.col("_lag")).otherwise(F.col("_entry"))
    return joined.withColumns({f"{prefix}{c}": source[c] for c in columns}).drop(
        "_segment", "_lag", "_entry"
    )


def running_totals(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    segments: Sequence[Column],
    values: dict[str, Column],
    how: str = "sum",
) -> DataFrame:
    """Sum (or ``how="max"``) of ``values`` over all rows before the current one.

    Order is (keys, order). ``segments`` are one or two expressions that never decrease
    along the order, the second refining the first. Totals are combined level by level,
    so no level sorts more rows than one segment holds. Rows must be unique in (keys,
    order). A sum over no rows is zero, a maximum over no rows is null.
    """
    keys = list(keys)
    levels = [f"_level{i}" for i in range(len(segments))]
    cut = frame.withColumns(dict(zip(levels, segments, strict=True)))
    names = list(values)
    cut = cut.withColumns({f"_v_{n}": v for n, v in values.items()})
    fold = F.max if how == "max" else F.sum

    def before(over) -> list[Column]:
        frame_before = over.rowsBetween(Window.unboundedPreceding, -1)
        found = [fold(f"_v_{n}").over(frame_before) for n in names]
        return found if how == "max" else [F.coalesce(c, F.lit(0)) for c in found]

    def combine(a: Column, b: Column) -> Column:
        return F.greatest(a, b) if how == "max" else a + b

    result = cut.withColumns(
        dict(
            zip(
                [f"{n}_before" for n in names],
                before(Window.partitionBy(*keys, *levels).orderBy(*order)),
                strict=True,
            )
        )
    )
    for depth in range(len(levels)):
        group = [*keys, *levels[: depth + 1]]
        totals = cut.groupBy(*group).agg(*[fold(f"_v_{n}").alias(f"_v_{n}") for n in names])
        over = Window.partitionBy(*keys, *levels[:depth]).orderBy(levels[depth])
        offsets = totals.select(
            *group, *[c.alias(f"_o_{n}") for n, c in zip(names, before(over), strict=True)]
        )
        result = result.join(offsets, group).withColumns(
            {f"{n}_before": combine(F.col(f"{n}_before"), F.col(f"_o_{n}")) for n in names}
        )
        result = result.drop(*[f"_o_{n}" for n in names])
    return result.drop(*levels, *[f"_v_{n}" for n in names])


def range_totals(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: dict[str, Column]
) -> DataFrame:
    """:func:`running_totals` over segments that Spark's range partitioning cuts by the data, for
    orders whose values crowd together. What is gathered is one row per key and partition. The
    cut rows are written before they are used, so a task that runs again cannot cut differently.
    """
    cut = frame.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    return running_totals(cut_lineage(cut), keys, order, [F.col("_range")], values).drop("_range")


def row_numbers(frame: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Numbers from 0 in the order of all rows, whatever their values look like.

    Spark's range partitioning cuts the order by the data; what is gathered is one row per
    partition. The numbered rows are written before they are used, so a task that runs again
    cannot number differently.
    """
    ranked = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = cut_lineage(ranked.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per partition of a shuffle.
    numbered = ranked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + inside).drop("_at", "_part", "_offset")
