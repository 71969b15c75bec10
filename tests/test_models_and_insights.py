import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablescope.errors import ValidationError
from tablescope.operators import forest, insights, isolation, supervised, unsupervised


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    n = 240
    frame = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "kind": rng.choice(["u", "v", "w"], n)})
    frame["name"] = [f"row {i}" for i in range(n)]
    frame["y"] = 3 * frame.a - 2 * frame.b + (frame.kind == "u") * 5
    frame["label"] = np.where(frame.a + rng.normal(0, 0.3, n) > 0, "yes", "no")
    frame.loc[::20, "b"] = np.nan
    return spark.createDataFrame(frame)


def test_task(spark, table):
    assert supervised.detect_task(table, "y") == "regression"
    assert supervised.detect_task(table, "label") == "classification"
    assert supervised.detect_task(table, "absent") == "unavailable"
    assert supervised.detect_task(table.limit(10), "y") == "unavailable"
    assert supervised.detect_task(spark.range(100).selectExpr("id % 3 AS t"), "t") == "classification"


def test_features_leave_out_identifiers(table):
    assert supervised.select_features(table, "y", ["a", "b", "kind", "name", "gone"]) == ["a", "b", "kind"]


def test_regression(table):
    exact = table.filter("b IS NOT NULL AND NOT isnan(b)")
    done = supervised.auto_train(exact, "y", ["a", "b", "kind"], trees=5, depth=4)
    rows = {r["model"]: r for r in done.results.collect()}
    assert rows["linear_regression"]["r2"] > 0.999 and rows["linear_regression"]["is_best"]
    assert rows["linear_regression"]["cv_mean"] > 0.999 and rows["random_forest"]["rmse"] > 0
    assert [r["feature"] for r in done.importance.limit(2).collect()] == ["kind=u", "a"]


def test_classification_and_unavailable(table):
    done = supervised.auto_train(table, "label", ["a", "kind"], trees=5, depth=3)
    assert all(r["accuracy"] > 0.7 and 0 < r["f1"] <= 1 for r in done.results.collect())
    none = supervised.auto_train(table.limit(5), "label")
    assert none.task == "unavailable" and none.results.count() == 0


def test_rare_levels_share_a_column(spark):
    df = spark.range(300).selectExpr("CASE WHEN id < 200 THEN concat('k', id % 10) ELSE concat('r', id) END AS c")
    prep = supervised.fit_preprocessor(df, ["c"])
    assert len(prep.columns) == 20 and "c=(rare)" in prep.columns
    unseen = spark.createDataFrame([("k1",)], "c string")
    assert prep.transform(unseen).first()["features"].toArray().sum() == 1.0


def test_split_is_exact_per_class(table):
    data = supervised.with_split(table, "label", "classification", 5)
    for r in data.groupBy("label").agg(F.count("*").alias("n"), F.count_if("_test").alias("t")).collect():
        assert abs(r["t"] - 0.2 * r["n"]) <= 1


def test_pca(table):
    done = unsupervised.pca(table, 2, ["a", "b", "y"])
    shares = [r["explained_ratio"] for r in done.explained.collect()]
    assert 0.9 < sum(shares) <= 1.0001 and shares[0] >= shares[1]
    load = done.loadings.toPandas().pivot(index="column", columns="component", values="loading").to_numpy()
    assert load.T @ load == pytest.approx(np.eye(2), abs=5e-3)
    scores = done.scores.select(F.avg("PC1"), F.corr("PC1", "PC2")).first()
    assert scores[0] == pytest.approx(0, abs=1e-9) and scores[1] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValidationError):
        unsupervised.pca(table, 2, ["a"])


def test_clusters(spark):
    rng = np.random.default_rng(2)
    points = [(float(x), float(y), c) for c, (cx, cy) in enumerate([(0, 0), (9, 0), (0, 9)]) for x, y in rng.normal([cx, cy], 0.5, (40, 2))]
    df = spark.createDataFrame(points, "x double, y double, truth int")
    done = unsupervised.kmeans(df, None, ["x", "y"], starts=2)
    assert done.k == 3 and done.silhouette > 0.8
    assert done.labelled.groupBy("truth").agg(F.count_distinct("cluster").alias("n")).filter("n > 1").count() == 0
    assert unsupervised.auto_k(df, ["x", "y"]).filter("is_best").first()["k"] == 3
    with pytest.raises(ValidationError):
        unsupervised.kmeans(df.limit(5), 2, ["x", "y"])


def test_euclidean_silhouette_and_its_interval(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 1, (1200, 3)), rng.normal(2.5, 1, (700, 3)), rng.normal(-3, 0.5, (99, 3)), [[50, 50, 50]]])
    label = np.repeat([0, 1, 2, 7], [1200, 700, 99, 1])
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    means = np.stack([distance[:, label == c].sum(1) / max((label == c).sum(), 1) for c in (0, 1, 2, 7)], 1)
    own = np.searchsorted([0, 1, 2, 7], label)
    size = np.bincount(own)[own]
    inside = means[np.arange(2000), own] * size / np.maximum(size - 1, 1)
    means[np.arange(2000), own] = np.inf
    outside = means.min(1)
    truth = np.where(size > 1, (outside - inside) / np.maximum(outside, inside), 0.0).mean()
    df = spark.createDataFrame([(p.tolist(), int(c)) for p, c in zip(points, label)], "features array<double>, cluster int")
    whole = unsupervised.silhouette_interval(df.repartition(3)).first()
    assert whole["silhouette"] == pytest.approx(truth, abs=1e-9) and whole["low"] == whole["high"] and whole["rows"] == 2000
    seen = {unsupervised.silhouette_interval(df.repartition(k), sample=300).first() for k in (1, 4)}
    (part,) = {tuple(round(v, 9) for v in r) for r in seen}  # the same rows whatever the layout
    assert part[1] < truth < part[2] and part[2] - part[1] < 0.1 and 300 <= part[3] < 320
    assert unsupervised.silhouette_interval(df.where("cluster = 0")).first()["silhouette"] is None


def test_deep_forest_learns_a_pattern_that_needs_depth(spark):
    # the class changes at 2 000 places, so a tree needs at least eleven levels, and much more with uneven cuts
    df = spark.range(12_000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(floor(id / 6) % 2 AS DOUBLE) AS _label")
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    shallow = forest.DeepForest(False, 8, 1, depth=10).fit(vectors)
    deep = forest.DeepForest(False, 8, 1).fit(vectors)
    right = [m.transform(vectors).where("_label = _prediction").count() / 12_000 for m in (shallow, deep)]
    assert right[0] < 0.7 and right[1] > 0.97
    assert deep.trees.agg(F.max("depth")).first()[0] > 15


def test_forests_do_not_depend_on_the_layout_and_both_ways_agree(spark, table, monkeypatch):
    exact = table.filter("b IS NOT NULL AND NOT isnan(b)")
    features = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(exact).withColumn("_label", F.col("y"))
    def predictions(df):
        return sorted((r["name"], round(r["_prediction"], 9)) for r in forest.DeepForest(True, 6, 3).fit(df).transform(df).collect())
    first = predictions(features.repartition(1))
    assert first == predictions(features.repartition(7, "b"))
    monkeypatch.setattr(forest, "LOOKUP_NODES", 10)
    assert first == predictions(features)


@pytest.mark.parametrize("regression", [True, False])
def test_forests_over_a_shallow_top(spark, monkeypatch, regression):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = np.floor(8 * x[:, 0]) % 2 + 2 * (x[:, 1] > 0.5) if not regression else np.sin(20 * x[:, 0]) + x[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, _label double")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).drop("a", "b", "c")
    train, test = vectors.randomSplit([0.7, 0.3], 5)
    scores = []
    for cells, nodes in ((forest.LOCAL_CELLS, forest.LOOKUP_NODES), (800, forest.LOOKUP_NODES), (800, 10)):
        monkeypatch.setattr(forest, "LOCAL_CELLS", cells)
        monkeypatch.setattr(forest, "LOOKUP_NODES", nodes)
        model = forest.DeepForest(regression, 12, 2).fit(train)
        assert (model.top is None) == (cells > 800)
        found = supervised.evaluate(model.transform(test), "regression" if regression else "classification")
        scores.append(found["r2" if regression else "accuracy"])
        weights = model.featureImportances.toArray()
        assert weights.sum() == pytest.approx(1) and weights.argmin() == 2
    assert min(scores) > 0.93 and max(scores) - min(scores) < 0.04 and scores[1] == pytest.approx(scores[2], abs=1e-9)


def test_a_tree_splits_until_leaves_are_pure():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 30, (400, 4)).astype(float), rng.normal(size=400)
    x = np.unique(x, axis=0)
    y = y[: len(x)]
    weight = rng.integers(1, 4, len(x)).astype(float)
    tree = forest.grow(x, y[:, None], weight, 4, None, rng)
    value = forest._leaf_values(x, tree.feature, tree.threshold, tree.left, tree.value, np.zeros((len(x), 1), int), tree.depth)
    assert value[:, 0] == pytest.approx(y)
    # all impurity is gone, and every split is the best one of its node
    mean = (weight * y).sum() / weight.sum()
    assert tree.importance.sum() == pytest.approx((weight * (y - mean) ** 2).sum()) and tree.root == pytest.approx(tree.importance.sum())
    best = max(
        ((weight[m] * (y - mean)[m]).sum() ** 2 / weight[m].sum() + (weight[~m] * (y - mean)[~m]).sum() ** 2 / weight[~m].sum())
        for f in range(4) for c in np.unique(x[:, f])[:-1] for m in [x[:, f] <= c]
    )
    m = x[:, tree.feature[0]] <= tree.threshold[0]
    assert best == pytest.approx(sum((weight[s] * (y - mean)[s]).sum() ** 2 / weight[s].sum() for s in (m, ~m)))


def test_poisson_weights():
    u = (np.arange(200_000) + 0.5) / 200_000
    for mean in (0.5, 1.0, 7.0, 49.0):
        drawn = forest.poisson(u, np.full(len(u), mean))
        assert drawn.mean() == pytest.approx(mean, rel=1e-3) and drawn.var() == pytest.approx(mean, rel=1e-2)
    assert forest.poisson(np.array([0.5]), np.array([1e6]))[0] == pytest.approx(1e6, rel=1e-3)


def test_splits_and_subsamples_follow_the_rows_not_their_places(spark):
    df = spark.range(3000).selectExpr("id % 700 AS v", "CAST(id % 2 AS STRING) AS label")
    def split(d):
        kept = supervised.with_split(d, "label", "classification", 5)
        return sorted(map(tuple, kept.groupBy("v", "label", "_fold", "_test").count().collect()))
    assert split(df.repartition(1)) == split(df.repartition(6, "v"))
    points = df.select(F.array(F.col("v").cast("double"), F.lit(1.0)).alias("features"))
    forests = [isolation.fit_forest(p, 3000, 1, 5) for p in (points.repartition(1), points.repartition(5))]
    pd.testing.assert_frame_equal(*forests)


def test_standardise(table):
    got = unsupervised.standardise(table, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("a"), F.count("b")).first()
    assert got[0] == pytest.approx(0, abs=1e-12) and got[1] == pytest.approx(1) and got[2] == 240


def test_report(messy):
    rows = insights.full_report(messy).collect()
    assert [s for s in dict.fromkeys(r["section"] for r in rows)] == insights.SECTIONS
    facts = {(r["section"], r["metric"]): r["value"] for r in rows}
    assert facts["executive_summary", "rows"] == 20
    assert facts["recommendations", "completeness"] == 80.0
    assert sum(r["section"] == "action_plan" for r in rows) == 4


def test_clean_table_has_no_risks(spark):
    df = spark.range(40).selectExpr("id % 7 AS n", "id AS m")
    assert insights.business_risks(insights.gather_facts(df)).first()["metric"] is None
