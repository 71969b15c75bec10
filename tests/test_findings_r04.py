import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablescope.operators import forest, supervised, unsupervised
from tablescope.plans import distance_sums


def _table(rng, n):
    """A normal column, a one-hot code of seven, a few numbers, a code of four that is not 0 or 1, a flag, a constant, unequal numbers."""
    codes = np.eye(7)[rng.integers(0, 7, n)], np.eye(4)[rng.integers(0, 4, n)] * 3 - 1
    return np.c_[rng.normal(size=n).round(2), codes[0], rng.integers(0, 40, n), codes[1], rng.integers(0, 2, n), np.zeros(n), rng.permutation(n)]


def _plan(x):
    return forest.plan_of(forest.few_values(x), lambda features, highs: forest.meetings(x, features, highs))


def test_one_hot_columns_share_a_histogram(monkeypatch):
    """sixteen features are five columns, and the trees are those of the features as they are."""
    rng = np.random.default_rng(4)
    x = _table(rng, 1500)
    plan = _plan(x)
    assert [len(f) for f, _, _ in plan.shared] == [7, 4, 1] and [f for f, _ in plan.numbered] == [8] and plan.ordered == [0, 15]
    cells, weight = plan.write(x), rng.integers(1, 4, 1500).astype(float)
    for classes in (2, 9):
        goal = np.eye(classes)[rng.integers(0, classes, 1500)]
        plain = forest.grow(x, goal, weight, 4, None, np.random.default_rng(1))
        for large, kept, once in ((4096, 1 << 22, 1 << 20), (100, 1 << 22, 1 << 20), (1, 1000, 500)):
            monkeypatch.setattr(forest, "_LARGE", large)
            monkeypatch.setattr(forest, "_SUMS_KEPT", kept)
            monkeypatch.setattr(forest, "_SUMS_AT_ONCE", once)
            shared = forest.grow(None, goal, weight, 4, None, np.random.default_rng(1), forest.presort(cells, plan))
            for part in ("feature", "threshold", "left", "value", "depth"):
                assert np.array_equal(getattr(plain, part), getattr(shared, part))


def test_sums_of_numbers_do_not_depend_on_their_order(monkeypatch):
    """numbers are added up exactly, so each split is the best one however its sums were found, and leaves are pure."""
    rng = np.random.default_rng(5)
    x = _table(rng, 1500)
    y, weight = rng.normal(size=1500) * 1e3, rng.integers(1, 4, 1500).astype(float)
    plan, trees = _plan(x), []
    cells = plan.write(x)
    for large, kept, once in ((4096, 1 << 22, 1 << 20), (100, 1 << 22, 1 << 20), (1, 1000, 500)):
        monkeypatch.setattr(forest, "_LARGE", large)
        monkeypatch.setattr(forest, "_SUMS_KEPT", kept)
        monkeypatch.setattr(forest, "_SUMS_AT_ONCE", once)
        trees.append(forest.grow(None, y[:, None], weight, 16, None, np.random.default_rng(1), forest.presort(cells, plan)))
    for tree in trees:
        for part in ("feature", "threshold", "left", "value"):
            assert np.array_equal(getattr(tree, part), getattr(trees[0], part))
    tree, root = trees[0], np.zeros((1500, 1), int)
    assert forest._leaf_values(x, tree.feature, tree.threshold, tree.left, tree.value, root, tree.depth)[:, 0] == pytest.approx(y, rel=1e-12)
    mean = (weight * y).sum() / weight.sum()
    best = max(
        (weight[m] * (y - mean)[m]).sum() ** 2 / weight[m].sum() + (weight[~m] * (y - mean)[~m]).sum() ** 2 / weight[~m].sum()
        for f in range(16) for c in np.unique(x[:, f])[:-1] for m in [x[:, f] <= c]
    )
    m = x[:, tree.feature[0]] <= tree.threshold[0]
    assert best == pytest.approx(sum((weight[s] * (y - mean)[s]).sum() ** 2 / weight[s].sum() for s in (m, ~m)))


@pytest.mark.parametrize("regression", [True, False])
def test_forests_of_many_rows_are_sent_in_few_columns(spark, monkeypatch, regression):
    """F1, F3: a table of 13 features and 500 rows fits one task that holds 4 000 numbers, and scores agree both ways."""
    names = [f"h{k}" for k in range(12)]
    df = spark.range(500).select(
        ((F.col("id") * 37) % 500).cast("double").alias("x"), *[(F.col("id") % 12 == k).cast("double").alias(f"h{k}") for k in range(12)],
        (F.col("id") % 2 if not regression else F.col("id") % 12 + F.col("id") / 1000).cast("double").alias("_label"),
    )
    vectors = VectorAssembler(inputCols=["x", *names], outputCol="features").transform(df).select("features", "_label")

    def scores(model):
        return sorted((r["_label"], round(r["_prediction"], 9)) for r in model.transform(vectors).collect())

    plain = scores(forest.DeepForest(regression, 5, 3).fit(vectors))
    monkeypatch.setattr(forest, "_PLAIN_ROWS", 10)
    monkeypatch.setattr(forest, "LOCAL_CELLS", 4000)  # 500 rows of 13 features would be 7 000 numbers
    model = forest.DeepForest(regression, 5, 3).fit(vectors)
    assert model.top is None
    found = scores(model)
    if not regression:
        assert found == plain
    monkeypatch.setattr(forest, "LOOKUP_NODES", 10)
    assert scores(model) == found
    right = supervised.evaluate(model.transform(vectors), "regression" if regression else "classification")
    assert right["r2" if regression else "accuracy"] > 0.95


def test_silhouette_of_a_plane_needs_no_pairs_of_far_points(spark, monkeypatch):
    """far boxes act through their nodes; the result is that of all pairs, whatever the points look like."""
    rng = np.random.default_rng(3)
    n = 3000
    cases = [
        np.c_[rng.normal(size=n) * 3, rng.integers(0, 25, n)],
        np.exp(rng.normal(size=(n, 2)) * 3),
        rng.normal(size=(n, 1)),
        np.r_[rng.normal(size=(n // 2, 2)) * 1e-3, rng.normal(size=(n // 2, 2)) + 1e6],
        rng.integers(0, 40, (n, 2)).astype(float),
    ]
    monkeypatch.setattr(distance_sums, "LEAF_POINTS", 50)
    met = []
    felt = distance_sums._felt
    monkeypatch.setattr(distance_sums, "_felt", lambda spark, boxes, far, classes: met.append(far.shape[1]) or felt(spark, boxes, far, classes))
    for x in cases:
        c = np.where(rng.random(n) < 0.6, (np.abs(x[:, 0]) * 2).astype(int) % 3, rng.integers(0, 4, n))
        c[0] = 77  # alone in its cluster
        df = spark.createDataFrame(list(zip(c.tolist(), x.tolist())), "cluster int, features array<double>")
        monkeypatch.setattr(unsupervised, "_MEETING_POINTS", 1 << 40)
        want = unsupervised.silhouette_exact(df).first()
        monkeypatch.setattr(unsupervised, "_MEETING_POINTS", 100)
        got = unsupervised.silhouette_exact(df).first()
        assert got["rows"] == want["rows"] == n and got["silhouette"] == pytest.approx(want["silhouette"], abs=1e-12)
    assert len(met) == 5 and min(met) > 100
    # what is no finite point of a plane still meets all
    odd = df.unionByName(spark.createDataFrame([(1, [None, 1.0])], df.schema))
    assert math.isnan(unsupervised.silhouette_exact(odd).first()["silhouette"])
    wide = df.withColumn("features", F.array_append("features", F.lit(1.0)))
    assert unsupervised.silhouette_exact(wide).first()["silhouette"] == pytest.approx(want["silhouette"], abs=1e-12)
    assert len(met) == 5
