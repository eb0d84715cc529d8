"""The detector queries ask for every candidate."""

import inspect

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructType

from gaugeworks.catalog import QUERIES
from gaugeworks.operators import models as D
from gaugeworks.plans import evaluation as V


def test_family_holdouts_fit_every_model(spark, sf_dir, monkeypatch):
    asked = inspect.signature(V.evaluate_holdouts)
    seen = []

    def spy(*args, **more):
        call = asked.bind(*args, **more)
        call.apply_defaults()
        seen.append((call.arguments["models"], call.arguments["trees"]))
        return spark.range(0)

    monkeypatch.setattr(V, "evaluate_holdouts", spy)
    QUERIES["detector_family_holdouts"].run(spark, sf_dir)
    assert seen == [(D.ML_MODELS, 300)]


def test_forest_in_parts_has_all_trees_and_their_mean(spark):
    """Parts that grow side by side, 7 trees in all: unequal sizes, other seeds, scores weighted by trees."""
    rows = [(Vectors.dense(float(i % 13), float(i * 7 % 11)), float(i % 13 + i * 7 % 11 > 11), 1.0) for i in range(200)]
    schema = StructType().add("features", VectorUDT()).add("y", DoubleType()).add("w", DoubleType())
    frame = spark.createDataFrame(rows, schema).repartition(6)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(D, "GROVES", 3)
        forest = D.fit_forest(frame, 7, 200, 2)
    assert sorted(grove.getNumTrees for grove in forest) == [2, 2, 3]
    assert all(grove.getCacheNodeIds() and grove.getMaxDepth() == D.DEEPEST for grove in forest)
    assert len({tree.toDebugString.split("\n", 1)[1] for grove in forest for tree in grove.trees}) == 7
    found = D.forest_score(frame, forest).select("features", "p").collect()
    for features, p in found[:20]:
        # A tree's own distribution, weights of its leaf in shares.
        shares = [tree.predictProbability(features)[1] for grove in forest for tree in grove.trees]
        assert p == pytest.approx(sum(shares) / 7)
    assert set(D.forest_score(frame, forest).columns) == {"features", "y", "w", "p"}
