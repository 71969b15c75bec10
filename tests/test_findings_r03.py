import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions import parsing
from tablescope.operators import clean, forest, supervised, timeseries, unsupervised
from workload import QUERIES
from workload.registry import MESSY_ORDERS


def test_trees_of_presorted_rows():
    """Dealt rows give what sorting each level gives: pure leaves, whatever the features look like."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=400).round(1), np.eye(5)[rng.integers(0, 5, 400)], np.zeros(400)]
    for goal in (rng.normal(size=(400, 1)), np.eye(3)[rng.integers(0, 3, 400)]):
        whole = forest.grow(x, goal, np.ones(400), 4, None, np.random.default_rng(1))
        kept = rng.random(400) < 0.6
        alone = forest.grow(x[kept], goal[kept], np.ones(kept.sum()), 4, None, np.random.default_rng(1))
        given = forest.grow(
            x[kept], goal[kept], np.ones(kept.sum()), 4, None, np.random.default_rng(1), forest._kept(forest.presort(x), kept)
        )
        assert (alone.feature == given.feature).all() and (alone.threshold == given.threshold).all()
        ends = np.zeros(400, int)
        for _ in range(whole.depth):
            ends = whole.left[ends] + (x[np.arange(400), whole.feature[ends]] > whole.threshold[ends])
        for leaf in np.unique(ends):
            mine = ends == leaf
            assert np.allclose(whole.value[leaf], goal[mine].mean(0))


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id % 20 AS a", "CAST(id % 3 AS STRING) AS b", "IF(id % 20 % 7 < 3, 'x', 'y') AS t")
    seen = []
    fit = forest.DeepForest.fit
    monkeypatch.setattr(forest.DeepForest, "fit", lambda self, fitted: seen.append(fitted.count()) or fit(self, fitted))
    found = supervised.auto_train(df, "t", trees=3).results.where("model = 'random_forest'").first()
    assert found["status"] == "ok" and found["accuracy"] == 1.0
    assert max(seen) <= 60


def test_cut_of_draws(spark):
    drawn = spark.range(5000).selectExpr("IF(id % 5 = 0, 'a', 'b') AS _class", "pmod(xxhash64(id), 4294967296) / 4294967296D AS _draw")
    got = {r["_class"]: r["q0"] for r in supervised._class_cuts(drawn).collect()}
    for name, cut in got.items():
        values = [r["_draw"] for r in drawn.where(F.col("_class") == name).collect()]
        assert cut == pytest.approx(np.quantile(values, 0.2), abs=1e-15)


def test_exact_silhouette_in_blocks(spark):
    rng = np.random.default_rng(2)
    points = [(int(c), [float(x), float(c)]) for c, x in zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300))] + [(7, [100.0, 3.0])]
    df = spark.createDataFrame(points, "cluster int, features array<double>")
    got = unsupervised.silhouette_exact(df, block_points=20).first()
    want = unsupervised.silhouette_interval(df).first()
    assert got["rows"] == 301 and got["silhouette"] == pytest.approx(want["silhouette"], rel=1e-12)
    bad = df.unionByName(spark.createDataFrame([(1, [None, 1.0])], df.schema))
    assert math.isnan(unsupervised.silhouette_exact(bad, block_points=20).first()["silhouette"])


def test_steps_up_to_one(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 301).selectExpr(
        "id AS o_orderkey", "id % 9 AS o_custkey", "'F' AS o_orderstatus", "id * 1.5D AS o_totalprice",
        "TIMESTAMP'1995-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    messy = spark.sql(MESSY_ORDERS.replace("FROM orders", "FROM {orders}"), orders=orders)
    plan, _ = clean.fit_plan(messy)
    want = {n: sorted(map(str, clean.replay(messy, plan, n).collect())) for n in (3, 5, 6)}
    fitted = []
    bounds = clean.winsor_bounds
    monkeypatch.setattr(clean, "winsor_bounds", lambda *a: fitted.append(1) or bounds(*a))
    for n, rows in want.items():
        assert sorted(map(str, clean.clean_upto(messy, n).collect())) == rows
    assert len(fitted) == 1


def test_related_keys_are_no_part_of_the_query(spark, tmp_path):
    """Order and customer numbers that grow together are related; the SQL of the query tells of columns only."""
    orders = spark.range(1, 301).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "id * 1.5D AS o_totalprice",
        "TIMESTAMP'1995-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert not [r for r in QUERIES["key_findings"](spark, str(tmp_path)).collect() if r["metric"] == "r"]


def test_interpolation_spreads_what_was_filled_up(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "_ROWS_OF_A_SORT", 50)
    days = spark.createDataFrame([(k, f"2024-0{m}-01", float(m)) for k in range(20) for m in (1, 9)], "k int, d string, y double")
    gaps = timeseries.resample_daily(days.withColumn("d", F.to_date("d")), "d", "y", ["k"])
    filled = timeseries.interpolate_linear(gaps, "day", "value", ["k"])
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and ", 99)" in plan  # 20 series of 245 days
    assert filled.count() == 4900 and filled.where("value IS NULL").count() == 0


def test_pure_cells_need_no_python(spark, monkeypatch):
    """a cell of one class is a leaf, however many rows it holds; it is not sent to one task."""
    monkeypatch.setattr(forest, "LOCAL_CELLS", 2000)
    ended = []
    leaves = forest.DeepForest._leaves
    monkeypatch.setattr(
        forest.DeepForest, "_leaves", staticmethod(lambda rows, *a: ended.append(rows.groupBy("tree", "cell").count().collect()) or leaves(rows, *a))
    )
    df = spark.range(3000).selectExpr("id % 50 AS size", "id AS noise", "IF(id % 50 > 25, 'a', 'b') AS step")
    trained = supervised.auto_train(df, "step", trees=4)
    assert trained.importance.first()["feature"] == "size"
    assert trained.results.where("model = 'random_forest'").first()["accuracy"] > 0.99
    assert max(r["count"] for r in ended[0]) > 500  # one class in a large cell


def test_frequent_dates_are_cast(spark):
    """frequent shapes are read without the interpreted grammar, to the same times; the grammar reads the rest."""
    fast = """2024-01-05 03:04|2024-01-05 03:04:05.678|2024-01-05T03:04:05Z|2024-01-05T03:04:05+0200|2024-01-05 03:04:05 UTC|2024/1/5 3:04
01/05/2024 12:04 AM|01/05/2024 12:04 pm|1/5/2024 03:04 PM|31/1/2024|13/13/2024|05.01.2024|5.1.24 10:11:12|1/5/68|1/5/69|01/05/2024 03:04:05.678
20240105|20240105T030405|20241305|2024-01|2024-W01|2020-W53|2021-W53|Jan 5 2024|Sept 5, 2024 3:04 PM|January-2024|5-Jan-2024|31 June 2024
5 January 2024 03:04|22nd march 2024|Fri, 05 Jan 2024|fri, 5 jan 2024 12:30 am|2024-02-30|2024-01-05 25:00""".replace("\n", "|").split("|")
    slow = "5th of May 2024|2024.1.5|Friday 5 May 2024|2024-01-05 03:04:60|2024-01-05T03:04:05+19:00|2024-01-05 03:04:05.1234567|1 may 24|x|2024|".split("|")
    mark = F.lit("1234-05-06").cast("timestamp_ntz")
    c = F.col("t")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for day_first in (False, True):
                rows = spark.createDataFrame([(v,) for v in [*fast, *slow, None]], "t string").select(
                    "t", parsing.parse_timestamp(c, day_first=day_first).alias("got"), parsing._by_grammar(c, day_first).alias("want"),
                    parsing._by_frequent_shape(c, day_first, mark).eqNullSafe(mark).alias("slow"),
                ).collect()
                assert [r for r in rows if r["got"] != r["want"]] == []
                assert {r["t"] for r in rows if r["slow"]} - {"13/13/2024"} == {*slow, None}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
