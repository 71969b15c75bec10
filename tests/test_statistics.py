import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.errors import ValidationError
from tablescope.functions import special
from tablescope.functions.normal import normal_quantile
from tablescope.operators import describe, isolation, outliers, relate


def integral(density, start, stop=None, points=400_001):
    """Area under a density, with the tail mapped onto a finite interval."""
    u = np.linspace(0.0, 1.0, points)[:-1]
    x = start + u / (1 - u) if stop is None else start + (stop - start) * u
    scale = 1 / (1 - u) ** 2 if stop is None else stop - start
    return np.trapezoid(density(x) * scale, u)


def t_density(v):
    front = math.gamma((v + 1) / 2) / math.gamma(v / 2) / math.sqrt(v * math.pi)
    return lambda x: front * (1 + x * x / v) ** (-(v + 1) / 2)


@pytest.mark.parametrize("t, v", [(0.3, 3), (2.228, 10), (-4.0, 7), (1.5, 60)])
def test_t_tail(t, v):
    assert special.t_two_sided(t, v) == pytest.approx(2 * integral(t_density(v), abs(t)), abs=1e-5)


@pytest.mark.parametrize("x, v", [(3.841, 1), (0.5, 4), (25.0, 10)])
def test_chi_square_tail(x, v):
    density = lambda y: y ** (v / 2 - 1) * np.exp(-y / 2) / (2 ** (v / 2) * math.gamma(v / 2))
    assert special.chi2_upper(x, v) == pytest.approx(integral(density, x), abs=1e-5)


def test_tables_of_critical_values():
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_upper(3.354131, 2, 27) == pytest.approx(0.05, abs=1e-6)
    assert special.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert special.normal_upper(1.959964) == pytest.approx(0.025, abs=1e-7)


def test_normal_quantile_column(spark):
    p = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.999999]
    df = spark.createDataFrame([(v,) for v in p], "p double").coalesce(1)
    got = [r["z"] for r in df.select(normal_quantile(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([special.normal_quantile(v) for v in p], rel=1e-12, abs=1e-12)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.normal(5, 2, 300), "b": rng.exponential(3, 300), "g": rng.integers(0, 3, 300).astype(str)})
    frame["c"] = frame.a * 2 + rng.normal(0, 1, 300)
    frame.loc[::10, "b"] = np.nan
    return spark.createDataFrame(frame), frame


def test_descriptive_stats_match_pandas(numbers):
    df, frame = numbers
    for row in describe.descriptive_stats(df, digits=9).collect():
        s = frame[row["column"]]
        expected = {
            "count": s.count(), "mean": s.mean(), "std": s.std(), "min": s.min(), "max": s.max(),
            "q25": s.quantile(0.25), "median": s.median(), "q75": s.quantile(0.75), "skew": s.skew(),
            "kurtosis": s.kurt(), "mad": (s - s.mean()).abs().mean(), "iqr": s.quantile(0.75) - s.quantile(0.25),
        }
        assert {k: row[k] for k in expected} == pytest.approx(expected, abs=1e-8)
        assert row["missing_pct"] == round(100 * s.isna().mean(), 1)


def test_no_numeric_column(spark):
    df = spark.createDataFrame([("x",), ("y",)], "a string")
    assert describe.descriptive_stats(df).count() == 0
    assert relate.correlation_matrix(df).count() == 0
    assert outliers.outlier_summary(df).count() == 0


def test_autocorrelation(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "i int, x double")
    got = {r["lag"]: r["autocorrelation"] for r in describe.autocorrelation(df, "x", ["i"], [1, 2, 9]).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(1.0), 9: None}
    assert describe.autocorrelation(df.limit(2), "x", ["i"]).count() == 0


def test_correlations_match_pandas(numbers):
    df, frame = numbers
    for method in ("pearson", "spearman"):
        expected = frame[["a", "b", "c"]].corr(method=method)
        got = relate.correlation_matrix(df, method, ["a", "b", "c"], digits=9).collect()
        assert len(got) == 9
        for r in got:
            assert r["r"] == pytest.approx(expected.loc[r["a"], r["b"]], abs=1e-8)
    with pytest.raises(ValidationError):
        relate.correlation_matrix(df, "other", ["a", "b"])


def test_constant_column_has_no_correlation(spark):
    df = spark.range(10).selectExpr("id AS a", "1 AS k")
    assert {r["r"] for r in relate.correlation_matrix(df).filter("a <> b").collect()} == {None}
    assert relate.spearman(df, "a", "k").first()["r"] is None
    assert relate.significant_correlations(df).count() == 0


def test_significant_correlations(numbers):
    df, frame = numbers
    rows = relate.significant_correlations(df).collect()
    assert [(r["feature_1"], r["feature_2"], r["strength"], r["direction"]) for r in rows] == [("a", "c", "strong", "positive")]
    assert rows[0]["p_value"] < 1e-50 and rows[0]["n"] == 300


def shapiro_wilk(values):
    """W and its p-value, value by value."""
    x = sorted(values)
    n = len(x)
    last, second, factor = relate.wilk_weights(n)
    weights = [factor * special.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    weights[0], weights[1], weights[-2], weights[-1] = -last, -second, second, last
    mean = sum(x) / n
    w = sum(a * v for a, v in zip(weights, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    return w, special.normal_upper(relate._wilk_z(w, n))


def test_shapiro_wilk(spark):
    # the published example of eleven weights
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.007, abs=0.001)
    rng = np.random.default_rng(5)
    rejected = [shapiro_wilk(rng.normal(size=50).tolist())[1] < 0.05 for _ in range(400)]
    assert 0.02 < np.mean(rejected) < 0.09
    for values in (rng.normal(size=40), rng.exponential(size=200), rng.integers(0, 6, 300).astype(float), rng.normal(size=9)):
        row = relate.normality_test(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").first()
        assert (row["test"], row["n"]) == ("shapiro-wilk", len(values))
        assert (row["w"], row["p_value"]) == pytest.approx(shapiro_wilk(values.tolist()), rel=1e-9)


def test_w_of_any_number_of_rows(spark, monkeypatch):
    """Scores of runs in closed form against ranks one by one, and the rate of false alarms."""
    from dataclasses import replace

    monkeypatch.setattr(relate, "SETTINGS", replace(relate.SETTINGS, wilk_rows=10))

    def francia(values):
        x, n = np.sort(values), len(values)
        z = [special.normal_quantile((i + 0.125) / (n + 0.25)) for i in range(n + 1)]
        score = (n + 0.25) * -np.diff([special.normal_density(v) for v in z])
        return ((x - x.mean()) @ score) ** 2 / ((x - x.mean()) @ (x - x.mean()) * (score @ score))

    rng = np.random.default_rng(2)
    for values in (rng.normal(size=3000), np.round(rng.normal(size=4001) * 3), rng.exponential(size=700), rng.integers(0, 2, 999) * 1.0):
        row = relate.normality_test(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").first()
        assert (row["test"], row["n"]) == ("shapiro-francia", len(values))
        assert row["w"] == pytest.approx(francia(values), rel=1e-6)
    for n in (101, 5000, 100_001):
        z = np.array([special.normal_quantile((i + 0.125) / (n + 0.25)) for i in range(n + 1)])
        score = (n + 0.25) * -np.diff(np.exp(-z * z / 2) / np.sqrt(2 * np.pi))
        assert relate.francia_norm(n) == pytest.approx(score @ score, rel=1e-12 if n < 40_000 else 1e-8)
        assert relate.francia_norm(n, single=200) == pytest.approx(score @ score, rel=1e-4)
    alarms = [relate._francia_z(francia(rng.normal(size=2000)), 2000) > 1.645 for _ in range(300)]
    assert 0.02 < np.mean(alarms) < 0.09


@pytest.mark.parametrize("ties", [False, True])
def test_rank_matrix_equals_pairs(spark, ties):
    rng = np.random.default_rng(7)
    table = rng.integers(0, 5 if ties else 10**6, (600, 6)).astype(float)
    table[:, 3] = -table[:, 0] + table[:, 3] / 3
    rows_ = [[None if (k % 3 == 0 and i % (4 + k) == 1) or (k == 4 and i % 5 == 1) else float(v) for k, v in enumerate(r)] for i, r in enumerate(table)]
    df = spark.createDataFrame([tuple(r) for r in rows_], ", ".join(f"c{k} double" for k in range(6))).repartition(5)
    found = relate.pair_correlations(df, "spearman")
    assert len(found) == 15
    for a, b, r, n in found:
        one = relate.spearman(df, a, b).first()
        assert n == one["n"] and r == pytest.approx(one["r"], abs=1e-12)


def test_columns_are_ranked_once_per_pattern_of_nulls(spark):
    assert len(relate._rankings([0] * 100)[0]) == 100
    assert len(relate._rankings([0, 0, 1, 1, 0])[0]) == 3 + 3 + 2  # the full columns also among the rows of pattern 1
    df = spark.range(50).selectExpr("id a", "IF(id = 3, NULL, id) b", "id + 1 c", "IF(id = 3, NULL, -id) d", "IF(id = 4, NULL, id) e")
    assert relate._null_patterns(df, ["a", "b", "c", "d", "e"]) == [0, 1, 0, 1, 2]


def test_rank_matrix_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    assert [(r, n) for _, _, r, n in relate.pair_correlations(df, "spearman")] == [(None, 3), (None, 0), (None, 0)]
    assert [(r, n) for _, _, r, n in relate.pair_correlations(df.limit(0), "spearman")] == [(None, 0)] * 3


def test_normality_test(spark, numbers):
    short = relate.normality_test(spark.createDataFrame([(1,), (2,), (3,)], "x int"), "x").first()
    assert short["status"] == "insufficient_data" and short["p_value"] is None
    df, _ = numbers
    assert not relate.normality_test(df, "a").first()["significant"]
    assert relate.normality_test(df, "b").first()["significant"]


def test_welch(spark):
    data = [("u", float(v)) for v in (1, 2, 3, 4, 5)] + [("v", float(v)) for v in (2, 4, 6, 8, 10)]
    df = spark.createDataFrame(data, "g string, y double")
    row = relate.t_test(df, "y", "g").first()
    assert row["statistic"] == pytest.approx(-3 / math.sqrt(2.5)) and row["dof"] == pytest.approx(6.25 / 1.0625)
    assert row["p_value"] == pytest.approx(2 * integral(t_density(row["dof"]), -row["statistic"]), abs=1e-5)
    assert relate.t_test(df.filter("g = 'u'"), "y", "g").first()["status"] == "needs_two_levels"


def test_anova(numbers):
    df, frame = numbers
    row = relate.anova_test(df, "a", "g").first()
    groups = [part.a for _, part in frame.groupby("g")]
    grand = frame.a.mean()
    between = sum(len(p) * (p.mean() - grand) ** 2 for p in groups) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in groups) / (300 - 3)
    assert row["statistic"] == pytest.approx(between / within) and (row["dof_between"], row["dof_within"]) == (2, 297)
    assert relate.anova_test(df.filter("g = '0'"), "a", "g").first()["status"] == "insufficient_data"


def test_chi_square(spark):
    cells = [("x", "p", 10), ("x", "q", 20), ("y", "p", 30), ("y", "q", 5)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string")
    row = relate.chi_square_test(df, "a", "b").first()
    expected = sum((abs(n - e) - 0.5) ** 2 / e for n, e in zip((10, 20, 30, 5), (30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65)))
    assert row["statistic"] == pytest.approx(expected) and row["dof"] == 1 and row["significant"]
    wide = df.unionAll(spark.createDataFrame([("z", "p")] * 4, "a string, b string"))
    table = pd.crosstab(*[wide.toPandas()[c] for c in ("a", "b")]).to_numpy().astype(float)
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert relate.chi_square_test(wide, "a", "b").first()["statistic"] == pytest.approx(((table - e) ** 2 / e).sum())
    assert relate.chi_square_test(df.filter("a = 'x'"), "a", "b").first()["status"] == "needs_two_by_two"


def test_interval_and_regression(spark, numbers):
    df, frame = numbers
    row = relate.confidence_interval(df, "a").first()
    half = special.t_quantile(0.975, 299) * frame.a.std() / math.sqrt(300)
    assert (row["low"], row["high"]) == pytest.approx((frame.a.mean() - half, frame.a.mean() + half), abs=1e-4)
    fit = relate.regression_diagnostics(df, "a", "c").first()
    slope, intercept = np.polyfit(frame.a, frame.c, 1)
    residuals = frame.c - slope * frame.a - intercept
    assert (fit["slope"], fit["intercept"]) == pytest.approx((slope, intercept), abs=1e-4)
    assert fit["residual_std"] == pytest.approx(residuals.std(), abs=1e-4)
    assert fit["std_err"] == pytest.approx(math.sqrt((residuals**2).sum() / 298 / ((frame.a - frame.a.mean()) ** 2).sum()), abs=1e-4)
    assert relate.regression_diagnostics(df.limit(3), "a", "c").first()["status"] == "insufficient_data"


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(42)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate([*rng.normal(0, 1, 100), 1000.0])], "i int, x double")


def test_planted_outlier(planted):
    flagged = {r["i"]: r for r in isolation.detect_anomalies(planted, ["x"]).collect()}
    assert flagged[100]["is_anomaly"] and "x=1000.0" in flagged[100]["anomaly_reason"]
    assert flagged[100]["anomaly_score"] == max(r["anomaly_score"] for r in flagged.values())
    assert sum(r["is_anomaly"] for r in flagged.values()) <= 8
    summary = outliers.outlier_summary(planted, ["x"]).first()
    assert summary["outliers"] >= 1
    assert outliers.anomaly_rate(isolation.detect_anomalies(planted, ["x"])).first()["anomalies"] >= 1


def test_small_tables_are_not_judged(spark):
    df = spark.range(5).selectExpr("id AS a", "id AS b")
    assert isolation.detect_anomalies(df).filter("is_anomaly").count() == 0


def test_isolation_share_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(2_000, 2))] + [(0.5, 0.5)] * 1_000
    df = spark.createDataFrame(rows, "a double, b double")
    scored = isolation.isolation_forest(df)
    share = scored.filter("is_isolated").count() / 3_000
    assert 0.03 < share <= 0.05
    far = scored.filter("abs(a) > 2.5 OR abs(b) > 2.5").agg(F.avg("isolation_score")).first()[0]
    near = scored.filter("abs(a) < 1 AND abs(b) < 1").agg(F.avg("isolation_score")).first()[0]
    assert far > 0 > near


def test_flat_column_has_no_spikes(spark):
    df = spark.range(50).selectExpr("id", "CAST(CASE WHEN id = 0 THEN 99 ELSE 1 END AS DOUBLE) AS x")
    assert outliers.robust_z_flags(df, ["x"]).filter("is_spike").count() == 0


def test_wide_tables_use_matrix_products(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 22)) @ rng.normal(size=(22, 22)) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    frame = pd.DataFrame(x, columns=[f"v{i}" for i in range(22)])
    frame["flat"] = 3.0
    got = relate.pair_correlations(spark.createDataFrame(frame))
    expected = frame.corr()
    assert len(got) == 23 * 22 // 2
    for a, b, r, n in got:
        assert n == (frame[a].notna() & frame[b].notna()).sum()
        assert r is None if "flat" in (a, b) else r == pytest.approx(expected.loc[a, b], abs=1e-9)
