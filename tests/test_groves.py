"""Trees that grow inside tasks: against Spark's trees, by hand, and without a model in the driver."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, LongType, StructType

from gaugeworks.operators import groves as G
from gaugeworks.operators import models as D

SCHEMA = StructType().add("_id", LongType()).add("features", VectorUDT()).add("y", DoubleType()).add("w", DoubleType())


def sample(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 5)), 2)
    y = (rng.random(n) < np.where(x[:, 0] + x[:, 1] > 1, 0.9, 0.1)).astype(float)
    rows = [(i, Vectors.dense(*map(float, x[i])), float(y[i]), 1.5 if y[i] else 0.75) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), x, y


def test_best_cut_is_that_of_all_cuts():
    """Both ways to count cells against every cut of every drawn column, weights and copies given."""
    rng = np.random.default_rng(1)
    for nodes, rows in ((2, 900), (60, 900)):
        codes = rng.integers(0, 256, (rows, 3)).astype(np.uint8)
        at, n = rng.integers(0, nodes, rows), rng.integers(1, 4, rows).astype(float)
        at[:nodes] = np.arange(nodes)
        y, w = rng.integers(0, 2, rows).astype(float), n * rng.choice([0.5, 2.0], rows)
        drawn = np.array([rng.permutation(3)[:2] for _ in range(nodes)])
        gain, column, cut = G.best_cuts(codes, np.arange(rows), at, nodes, drawn, n, w, w * y)

        def impurity(own):
            share = (w * y)[own].sum() / w[own].sum()
            return 1 - share**2 - (1 - share) ** 2

        for node in range(nodes):
            own, best = at == node, 0.0
            for f in drawn[node]:
                for c in range(255):
                    left, right = own & (codes[:, f] <= c), own & (codes[:, f] > c)
                    if n[left].sum() >= 2 and n[right].sum() >= 2:
                        parts = sum(w[part].sum() * impurity(part) for part in (left, right)) / w[own].sum()
                        best = max(best, impurity(own) - parts)
            assert max(0.0, gain[node]) == pytest.approx(best, abs=1e-9)
            assert (column[node] < 0) == (best < 1e-11) and (column[node] < 0 or column[node] in drawn[node])


def test_tree_leaves_hold_two_rows_and_their_share():
    rng = np.random.default_rng(2)
    codes, y, w = rng.integers(0, 256, (400, 4)).astype(np.uint8), rng.integers(0, 2, 400).astype(float), np.ones(400)
    tree = G.Tree(codes, y, w, (5, 6), 30)
    copies = np.random.default_rng((5, 6)).poisson(1.0, 400)
    shares = tree.score(codes)
    for share in np.unique(shares):
        own = (shares == share) & (copies > 0)
        if own.any():
            assert copies[own].sum() >= 2 and share == pytest.approx((copies * y)[own].sum() / copies[own].sum())
    stump = G.Tree(codes, y, w, (5, 6), 1)
    assert len(stump.column) == 3 and list(stump.column[1:]) == [-1, -1]


def test_scores_are_like_those_of_a_forest_of_spark(spark):
    frame, _, y = sample(spark)
    other, x, _ = sample(spark, 300, 9)
    found = {r["_id"]: r["p"] for r in G.grown_and_scored(frame.drop("_id"), other.select("_id", "features"), 5, 60, 30, 3).collect()}
    again = {r["_id"]: r["p"] for r in G.grown_and_scored(frame.drop("_id"), other.select("_id", "features"), 5, 60, 30, 3).collect()}
    assert found == again and sorted(found) == list(range(300))
    forest = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=60, maxDepth=30, maxBins=256, minInstancesPerNode=2, seed=3)
    wanted = {r["_id"]: r["probability"][1] for r in forest.fit(frame).transform(other).collect()}
    p, q = (np.array([d[i] for i in range(300)]) for d in (found, wanted))
    truth = x[:, 0] + x[:, 1] > 1
    assert np.corrcoef(p, q)[0, 1] > 0.9 and abs(p.mean() - q.mean()) < 0.03
    assert abs(((p > 0.5) == truth).mean() - ((q > 0.5) == truth).mean()) < 0.06


def test_no_forest_of_the_driver_is_fitted(spark, monkeypatch):
    """All 300 trees of a training part that fits a task grow there."""
    frame, _, _ = sample(spark, 200)
    rows = frame.selectExpr("y", "_id % 4 AS run_id", "rand(5) AS c", "y + rand(6) AS d")
    seen = []

    def spy(fitting, asked, columns, trees, depth, seed):
        seen.append((columns, trees, depth))
        return G.grown_and_scored(fitting, asked, columns, 3, depth, seed)

    def refused(*_):
        raise AssertionError("a forest in the driver")

    monkeypatch.setattr(D, "grown_and_scored", spy)
    monkeypatch.setattr(D, "fit_forest", refused)
    scored = D.fit_and_score(rows, rows, D.fit_preprocessing(rows, ["c", "d"]), "random_forest")
    assert seen == [(2, 300, D.DEEPEST)]
    assert scored.columns == [*rows.columns, "p"] and scored.where("p between 0 and 1").count() == 200
    assert D.fit_and_score(rows, rows.limit(0), D.fit_preprocessing(rows, ["c", "d"]), "random_forest").isEmpty()
