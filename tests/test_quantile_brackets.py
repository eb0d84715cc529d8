"""Exact quantiles where a sketch comes out differently each time it is computed."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.quantiles import exact_median


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_median_does_not_depend_on_where_rows_lie(spark, no_reuse):
    """A shuffle delivers its parts in any order; here every reader finds the rows dealt anew."""

    def dealt(batches):
        draw = random.SystemRandom()
        for batch in batches:
            yield batch.assign(at=[draw.randrange(1 << 30) for _ in range(len(batch))])

    rng = random.Random(7)
    values = [rng.randrange(10**7) for _ in range(40_001)]
    frame = spark.createDataFrame(pd.DataFrame({"k": 1, "x": values}))
    rows = frame.mapInPandas(dealt, "k long, x long, at long").repartition(4, "at")
    found = exact_median(rows, ["k"], F.col("x")).collect()
    assert [(r["n"], r["median"]) for r in found] == [(40_001, sorted(values)[20_000])]
