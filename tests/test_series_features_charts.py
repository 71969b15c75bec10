import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.errors import ValidationError
from tablescope.functions import smoothing
from tablescope.functions.smoothing import fit_additive
from tablescope.operators import charts, features, timeseries


def series(spark, values, start="2024-01-01"):
    days = pd.date_range(start, periods=len(values))
    return spark.createDataFrame(
        [(d.to_pydatetime(), float(v)) for d, v in zip(days, values) if v is not None], "d timestamp, y double"
    )


def test_trend(spark):
    up = timeseries.trend_direction(series(spark, range(10)), "y", ["d"]).first()
    assert (up["trend"], up["slope"], up["points"]) == ("increasing", 1.0, 10)
    assert up["pct_change"] == pytest.approx(round(10 / 4.5 * 100, 2))
    assert timeseries.trend_direction(series(spark, [3] * 6), "y", ["d"]).first()["trend"] == "flat"
    assert timeseries.trend_direction(series(spark, [1, 2]), "y", ["d"]).first()["trend"] == "insufficient_data"
    split = timeseries.trend_direction(series(spark, range(10)), "y", ["d"], hot_group_rows=3).first()
    assert split == up


def test_summary(spark):
    row = timeseries.time_series_summary(series(spark, range(10)), "d", "y").first()
    assert (row["points"], str(row["start"]), str(row["end"])) == (10, "2024-01-01", "2024-01-10")


def test_calendar_and_interpolation(spark):
    df = series(spark, [1, None, None, 4, None, 2])
    gaps = [r["value"] for r in timeseries.resample_daily(df, "d", "y").orderBy("day").collect()]
    assert gaps == [1, None, None, 4, None, 2]
    filled = [r["value"] for r in timeseries.daily_series(df, "d", "y").orderBy("day").collect()]
    assert filled == pytest.approx([1, 2, 3, 4, 3, 2])
    ends = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 9.0), (5, None)], "i int, v double")
    got = [r["v"] for r in timeseries.interpolate_linear(ends, "i", "v").orderBy("i").collect()]
    assert got == [None, 5.0, 7.0, 9.0, 9.0]


def test_decomposition_recovers_line_and_season(spark):
    pattern = np.array([3, -1, 0, 2, -2, -1, -1.0])
    values = [10 + 0.5 * i + pattern[i % 7] for i in range(28)]
    parts = timeseries.seasonal_decompose(series(spark, values), "d", "y", 7).orderBy("day").toPandas()
    assert parts.trend.to_numpy() == pytest.approx(10 + 0.5 * np.arange(28))
    assert parts.seasonal.to_numpy() == pytest.approx(np.tile(pattern, 4))
    assert np.abs(parts.resid).max() < 1e-9
    assert timeseries.seasonal_decompose(series(spark, values[:10]), "d", "y", 7).count() == 0


def test_smoothing_continues_an_exact_pattern():
    pattern = np.array([5, 1, -2, 0, 3, -4, -3.0])
    y = np.array([100 + 2 * i + pattern[i % 7] for i in range(35)])
    ahead, spread = fit_additive(y, 14)
    assert ahead == pytest.approx([100 + 2 * i + pattern[i % 7] for i in range(35, 49)], abs=1e-6)
    assert spread == pytest.approx(0, abs=1e-6)


def test_forecast(spark):
    one = series(spark, [20 + i % 7 for i in range(28)]).withColumn("k", F.lit("a"))
    two = series(spark, [5.0] * 30).withColumn("k", F.lit("b"))
    few = series(spark, range(5)).withColumn("k", F.lit("c"))
    got = timeseries.holt_winters_forecast(one.unionAll(two).unionAll(few), "d", "y", 30, ["k"]).toPandas()
    assert set(got.k) == {"a", "b"}
    future = got[got.is_forecast]
    assert (future.groupby("k").size() == 30).all()
    assert (future.yhat_lower <= future.yhat + 1e-9).all() and (future.yhat <= future.yhat_upper + 1e-9).all()
    assert future[future.k == "b"].yhat.to_numpy() == pytest.approx(np.full(30, 5.0), abs=1e-6)
    assert timeseries.holt_winters_forecast(few, "d", "y").count() == 0
    later = timeseries.forecast_after(timeseries.holt_winters_forecast(one, "d", "y"), datetime.date(2024, 1, 28))
    assert later.count() == 30


def test_lag_and_calendar_features(spark):
    df = series(spark, [10, 12, 14, 11, 15, 16]).withColumn("region", F.lit("north"))
    made, created = features.engineer_features(df, ["d"], max_lags=2)
    rows = made.orderBy("d").collect()
    assert [r["y_lag_1"] for r in rows] == [None, 10, 12, 14, 11, 15]
    assert [r["y_lag_2"] for r in rows][:3] == [None, None, 10]
    assert rows[3]["y_rolling_mean_3"] == pytest.approx((12 + 14 + 11) / 3)
    assert rows[0]["day_of_week"] == 0 and rows[0]["d_year"] == 2024 and rows[0]["region_freq"] == 6
    assert {"y_lag_1", "day_of_week", "region_freq"} <= set(created)
    more, _ = features.engineer_features(df, ["d"], calendar_lags=True)
    assert "d_month_lag_1" in more.columns


def test_empty_dates_are_skipped(spark):
    df = spark.createDataFrame([(1, None)], "n int, d timestamp")
    assert features.calendar_features(df).columns == ["n", "d"]


def test_frequencies_count_nulls_and_skip_many_levels(spark):
    df = spark.range(60).selectExpr("CAST(id AS STRING) AS many", "nullif(CAST(id % 3 AS STRING), '0') AS few")
    made = features.frequency_features(df)
    assert made.columns == ["many", "few", "few_freq"]
    assert {(r["few"], r["few_freq"]) for r in made.collect()} == {(None, 20), ("1", 20), ("2", 20)}


def test_far_dates_are_one_run(spark):
    days = [(f"2024-01-{d:02d}", 10.0 + d % 7) for d in range(1, 21)] + [("9999-12-31", 12.0)]
    df = spark.createDataFrame(days, "d string, y double").select(F.to_date("d").alias("d"), "y")
    runs = timeseries.calendar_runs(df, "d", "y").orderBy("day").collect()
    assert len(runs) == 21 and runs[-2]["days"] > 2_900_000 and runs[-1]["days"] == 1
    assert sum(r["days"] for r in runs) == (runs[-1]["day"] - runs[0]["day"]).days + 1
    ahead = timeseries.holt_winters_forecast(df, "d", "y").where("is_forecast")
    assert ahead.count() == 0  # the calendar ends there
    near = df.where("d < '2025-01-01'").unionByName(spark.sql("SELECT DATE'2999-01-01' AS d, 12.0D AS y"))
    found = timeseries.holt_winters_forecast(near, "d", "y", 5).where("is_forecast").orderBy("ds").collect()
    assert str(found[0]["ds"]) == "2999-01-02" and len(found) == 5 and all(abs(r["yhat"] - 12) < 0.1 for r in found)


def test_a_long_line_is_walked_as_its_days():
    rng = np.random.default_rng(2)
    at = np.concatenate([np.arange(20), [300, 301, 302, 303, 304, 500, 501]])
    v = rng.normal(10, 2, len(at))
    days = np.interp(np.arange(at[-1] + 1), at, v)
    length, rise = np.append(np.diff(at), 1), np.append(np.diff(v) / np.diff(at), 0)
    one, each = smoothing.fit_additive(v, 20, length, rise), smoothing.fit_additive(days, 20)
    assert one[0] == pytest.approx(each[0], rel=1e-9) and one[1] == pytest.approx(each[1], rel=1e-9)


def test_forecast_of_a_line_with_a_week(spark):
    df = spark.range(70).selectExpr("date_add(DATE'2024-01-01', CAST(id AS INT)) AS d", "CAST(5 + 0.5 * id + (id % 7) * (id % 7) AS DOUBLE) AS y")
    found = timeseries.holt_winters_forecast(df, "d", "y", 14).where("is_forecast").orderBy("ds").collect()
    for k, r in enumerate(found, 70):
        assert r["yhat"] == pytest.approx(5 + 0.5 * k + (k % 7) ** 2, abs=1e-6)


def test_ties_in_the_order_do_not_depend_on_size_or_layout(spark):
    df = spark.range(400).selectExpr("id % 3 AS o", "CAST(id * 37 % 101 AS DOUBLE) AS y", "CAST(IF(id % 4 = 0, NULL, id) AS DOUBLE) AS z")
    seen = set()
    for limit in (10**6, 1):
        for parts in (1, 5):
            t = timeseries.trend_direction(df.repartition(parts), "y", ["o"], hot_group_rows=limit).first()
            filled = timeseries.interpolate_linear(df.repartition(parts), "o", "z", hot_group_rows=limit, block_rows=64)
            seen.add((t["slope"], t["pct_change"], round(filled.agg(F.sum("z")).first()[0], 6)))
    assert len(seen) == 1


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"x": rng.normal(size=500), "y": rng.exponential(size=500), "g": rng.integers(0, 3, 500).astype(str)})
    return spark.createDataFrame(frame), frame


def test_histogram(table):
    df, frame = table
    rows = charts.histogram(df, "x", 20).collect()
    counts, edges = np.histogram(frame.x, 20)
    assert {r["bin"]: r["n"] for r in rows} == {i: c for i, c in enumerate(counts) if c}
    flat = df.selectExpr("1.0D AS x")
    assert [r["n"] for r in charts.histogram(flat, "x").collect()] == [500]
    fine = {r["bin"]: r["n"] for r in charts.histogram(df, "x", 200).collect()}
    assert fine == {i: c for i, c in enumerate(np.histogram(frame.x, 200)[0]) if c}


def test_density_integrates_to_one(table):
    df, frame = table
    curve = charts.kde(df, "x").orderBy("point").toPandas()
    h = frame.x.std() * 500 ** -0.2
    at = curve.x.iloc[100]
    expected = np.exp(-0.5 * ((at - frame.x) / h) ** 2).sum() / (500 * h * np.sqrt(2 * np.pi))
    assert curve.density.iloc[100] == pytest.approx(expected)
    assert 0.95 < np.trapezoid(curve.density, curve.x) <= 1.0
    assert charts.kde(df.limit(2), "x").count() == 0
    assert charts.violin(df, "g", "y").count() == 600


def exact_density(values, at):
    h = values.std() * len(values) ** -0.2
    return np.exp(-0.5 * ((at - values.to_numpy()[:, None]) / h) ** 2).sum(0) / (len(values) * h * np.sqrt(2 * np.pi)), h


@pytest.mark.parametrize("groups", [charts._LOOKUP_GROUPS, 0])
def test_densities_stay_within_the_stated_error(spark, monkeypatch, groups):
    monkeypatch.setattr(charts, "_LOOKUP_GROUPS", groups)
    rng = np.random.default_rng(11)
    parts = {
        "normal": rng.normal(1e6, 3, 900), "far": np.append(rng.normal(size=300), 5000.0), "few": rng.integers(0, 3, 400) * 1.0,
        "three": np.array([1.0, 2.0, 4.0]), "two": np.array([1.0, 2.0]), "flat": np.full(50, 7.0), "skewed": rng.pareto(1.5, 800),
    }
    frame = pd.DataFrame([(g, float(v)) for g, x in parts.items() for v in x], columns=["g", "y"])
    curves = charts._densities(spark.createDataFrame(frame).repartition(5), "y", ["g"]).toPandas()
    assert set(curves.g) == set(parts) - {"two", "flat"}
    for g, curve in curves.groupby("g"):
        curve = curve.sort_values("point")
        values = frame[frame.g == g].y
        expected, h = exact_density(values, curve["at"].to_numpy())
        assert curve.point.tolist() == list(range(200))
        # the bound, and what doubles lose in the distances
        assert np.abs(curve.density - expected).max() < 1e-12 / h + 1e-9 * expected.max()
        alone = charts.kde(spark.createDataFrame(frame[frame.g == g]), "y").orderBy("point").toPandas()
        assert np.abs(alone.density.to_numpy() - expected).max() < 1e-12 / h + 1e-9 * expected.max()


def test_densities_need_no_python_worker_and_no_join_of_rows(spark):
    df = spark.range(5000).selectExpr("CAST(id % 3 AS STRING) AS g", "CAST(id * id % 977 AS DOUBLE) AS y")
    plan = charts._densities(df, "y", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_box_of_a_column_and_of_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"y": rng.exponential(size=700)})
    df = spark.createDataFrame(frame)
    (row,) = charts.box_stats(df, None, "y").collect()
    assert "x" not in row.asDict() and row["n"] == 700
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx(tuple(frame.y.quantile([0.25, 0.5, 0.75])))
    # one hot group among very many small ones, looked up or joined
    wide = spark.range(60_000).selectExpr("IF(id % 3 = 0, -1, id) AS g", "CAST(id * 7919 % 1000 AS DOUBLE) AS y")
    seen = []
    for limit in (10**6, 10):
        monkeypatch.setattr(charts, "_LOOKUP_GROUPS", limit)
        seen.append(charts.box_stats(wide, "g", "y").agg(F.count("*"), F.sum("n"), F.sum("median"), F.sum("outliers")).first())
    assert seen[0] == seen[1] and seen[0][0] == 40_001 and seen[0][1] == 60_000


@pytest.mark.parametrize("agg", ["median", "var", "nunique", "std", "mean", "count"])
def test_bar_aggregates(spark, agg):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": rng.integers(0, 6, 300).astype(str), "y": np.round(rng.normal(size=300), 1)})
    frame.loc[frame.g == "5", "y"] = np.nan
    found = {r["x"]: r["value"] for r in charts.bar(spark.createDataFrame(frame), "g", "y", agg).collect()}
    expected = frame.groupby("g").y.agg(agg)
    assert set(found) == set(expected.index)
    for g, v in expected.items():
        assert (found[g] is None and np.isnan(v)) or found[g] == pytest.approx(v)


def test_box(table):
    df, frame = table
    for r in charts.box_stats(df, "g", "y").collect():
        part = frame[frame.g == r["x"]].y
        q1, q2, q3 = part.quantile([0.25, 0.5, 0.75])
        inside = part[part.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        assert (r["whisker_low"], r["whisker_high"], r["outliers"]) == (inside.min(), inside.max(), len(part) - len(inside))


def test_ecdf_and_qq(table):
    df, frame = table
    assert charts.ecdf(df, "x").agg(F.max("share")).first()[0] == 1.0
    points = charts.qq(df, "x").orderBy("position").toPandas()
    assert points.value.to_numpy() == pytest.approx(np.sort(frame.x))
    assert points.probability.iloc[0] == pytest.approx(1 - 0.5 ** (1 / 500))
    line = charts.qq_line(df, "x").first()
    assert line["slope"] == pytest.approx(1, abs=0.1) and line["n"] == 500
    hot = charts.qq(df.selectExpr("1.5D AS x"), "x")
    assert hot.count() == 500 and hot.select("position").distinct().count() == 500


def test_chart_choice(spark, messy, table):
    assert charts.auto_charts(messy.select("region")).count() == 0
    plan = charts.auto_charts(messy.select("id", "constant_col", "region", "sparse_col"))
    assert [r["kind"] for r in plan.orderBy("ord").collect()] == [
        "bar", "count", "scatter", "histogram", "heatmap", "box", "missing",
    ]
    df, _ = table
    assert charts.chart_insight(df, "histogram", "y").filter("metric = 'skew'").first()["label"] == "right-skewed"
    assert charts.chart_insight(df, "scatter", "x", "y").first()["label"].startswith("weak")
    assert charts.chart_insight(df, "other").first()["metric"] is None
    assert charts.chart_insight(messy, "missing").first()["value"] == 20.0


def test_bars(table):
    df, frame = table
    top = charts.bar(df, "g", "y").collect()
    assert [r["x"] for r in top] == list(frame.groupby("g").y.mean().sort_values(ascending=False).index)
    with pytest.raises(ValidationError):
        charts.bar(df, "g", "y", "mode")
    assert sum(r["share"] for r in charts.pie(df, "g").collect()) == pytest.approx(1)
    levels = charts.hierarchy(df, ["g"], "y")
    assert levels.filter("level = 0").first()["value"] == pytest.approx(frame.y.sum())


def test_rolling_average_split(spark):
    df = series(spark, [float(i * i % 17) for i in range(60)])
    plain = charts.rolling_average(df, "d", "y", 7).orderBy("d").toPandas()
    split = charts.rolling_average(df, "d", "y", 7, hot_group_rows=5, block_rows=9).orderBy("d").toPandas()
    expected = plain.y.rolling(7, min_periods=1).mean()
    assert plain["rolling"].to_numpy() == pytest.approx(expected.to_numpy())
    assert split["rolling"].to_numpy() == pytest.approx(expected.to_numpy())


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_interpolation_across_blocks(spark, keys):
    df = spark.range(400).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 5) END AS k",
        "CASE WHEN hash(id) % 6 = 0 OR id BETWEEN 100 AND 103 THEN CAST(id * id % 101 AS DOUBLE) END AS v",
    )
    plain = timeseries.interpolate_linear(df, "id", "v", keys)
    split = timeseries.interpolate_linear(df, "id", "v", keys, hot_group_rows=10, block_rows=7)
    a, b = ({r["id"]: r["v"] for r in x.collect()} for x in (plain, split))
    assert a == pytest.approx(b, nan_ok=True) and len(a) == 400
    if not keys:
        expected = df.toPandas().sort_values("id").v.interpolate()
        assert [a[i] for i in range(400) if a[i] is not None] == pytest.approx(expected.dropna().tolist())


def test_many_series_are_fitted_side_by_side(spark):
    rng = np.random.default_rng(5)
    many = []
    for i in range(60):
        length = rng.integers(1, 4, 30 if i % 2 else rng.integers(1, 30))
        length[-1] = 1
        y = rng.normal(100, 20, len(length)) + i * np.arange(len(length))
        many.append((y, length, np.append(np.diff(y), 0.0) / length))
    many.append((np.array([1.0, 5.0]), np.array([300, 1]), np.array([4 / 300, 0.0])))
    alone = [smoothing.fit_additive(y, 9, length, rise) for y, length, rise in many]
    calls, single = [], smoothing._minimise
    smoothing._minimise = lambda *a: calls.append(1) or single(*a)
    try:
        together = smoothing.fit_many(many, 9)
    finally:
        smoothing._minimise = single
    for (a, s), (b, t) in zip(alone, together):
        assert np.allclose(a, b, rtol=1e-5) and s == pytest.approx(t, rel=1e-5, abs=1e-6)
    assert len(calls) < 30  # few of a kind and long runs only
    days = spark.range(240).selectExpr("id % 12 AS k", "date_add(DATE'2024-01-01', CAST(id / 12 AS INT)) AS d", "id * 1.0D AS y")
    found = timeseries.holt_winters_forecast(days, "d", "y", 3, ["k"])
    assert found.where("is_forecast").groupBy("k").count().where("count = 3").count() == 12
