"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import staged


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """Edges seen from both ends with the smallest node next to (or at) ``u``."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges(a, b)``; root is the smallest node it reaches.

    Each round is two grouped minima with map-side combine and two joins, all on rows of two
    integers; the number of rounds grows with the logarithm of the longest path. Self loops only
    add their node. No edges: no rows.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = staged(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = _state(current)
    while state[0]:
        large = _smallest_neighbour(current).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct("m", F.col("v").alias("x")), F.struct("m", F.col("u").alias("x")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        current = staged(small, "edges")
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
