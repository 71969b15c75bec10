"""Correlations, tests and intervals; p-values are covered by the unit tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablescope.functions import normal
from tablescope.operators import relate
from workload.registry import query, rounded

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(table: str, columns: list[str], digits: int = 3) -> str:
    # Adding 0.0 turns a rounded negative zero into zero.
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CAST(1 AS DOUBLE) AS r" if a == b else
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), {digits}) + 0.0 AS r FROM {table}"
        for a in columns
        for b in columns
    )


@query(_matrix_sql("lineitem", LINE))
def correlation_matrix(t):
    return relate.correlation_matrix(t.lineitem, columns=LINE).withColumn("r", F.col("r") + 0.0)


def _rank_sql(a: str, b: str, table: str) -> str:
    return (
        f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
        f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
        f"FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    )


@query(f"SELECT round(corr(ra, rb), 6) AS r, count(*) AS n FROM ({_rank_sql('o_totalprice', 'o_custkey', 'orders')})")
def spearman(t):
    return rounded(relate.spearman(t.orders, "o_totalprice", "o_custkey"), 6)


@query(f"SELECT round(corr(ra, rb), 6) AS r, count(*) AS n FROM ({_rank_sql('l_quantity', 'l_discount', 'lineitem')})")
def spearman_with_ties(t):
    return rounded(relate.spearman(t.lineitem, "l_quantity", "l_discount"), 6)


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 3) + 0.0 AS r "
        f"FROM ({_rank_sql(a, b, 'part')})" if a != b else f"SELECT '{a}' AS a, '{b}' AS b, CAST(1 AS DOUBLE) AS r"
        for a in ("p_size", "p_retailprice", "p_partkey")
        for b in ("p_size", "p_retailprice", "p_partkey")
    )
)
def spearman_matrix(t):
    found = relate.correlation_matrix(t.part, "spearman", ["p_size", "p_retailprice", "p_partkey"])
    return found.withColumn("r", F.col("r") + 0.0)


_DERIVED = (
    "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, "
    "l_extendedprice * l_tax AS tax, l_discount FROM lineitem)"
)
_DERIVED_COLUMNS = ["l_quantity", "l_extendedprice", "net", "tax", "l_discount"]


@query(
    "SELECT feature_1, feature_2, round(r, 3) AS r, n, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength, "
    "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r, count(*) AS n FROM {_DERIVED}"
        for a, b in combinations(_DERIVED_COLUMNS, 2)
    )
    + ") WHERE n >= 5 AND abs(r) >= 0.4"
)
def significant_correlations(t):
    table = t.lineitem.selectExpr(
        "l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net",
        "l_extendedprice * l_tax AS tax", "l_discount",
    )
    return relate.significant_correlations(table).drop("p_value")


def _ratio_sql(top: list[float], bottom: list[float], x: str) -> str:
    def horner(coefficients):
        text = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            text = f"({text} * {x} + {c!r}::DOUBLE)"
        return text

    return f"({horner(top)} / {horner(bottom)})"


def _quantile_sql(p: str) -> str:
    """Inverse of the normal distribution function at the column ``p``."""
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"({p} - 0.5) * " + _ratio_sql(normal.CENTRE_TOP, normal.CENTRE_BOTTOM, f"(0.180625 - pow({p} - 0.5, 2))")
    middle = _ratio_sql(normal.MIDDLE_TOP, normal.MIDDLE_BOTTOM, f"({r} - 1.6)")
    far = _ratio_sql(normal.FAR_TOP, normal.FAR_BOTTOM, f"({r} - 5)")
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {centre} ELSE sign({p} - 0.5) * CASE WHEN {r} <= 5 THEN {middle} ELSE {far} END END"


_MOMENTS = """SELECT skewness(value) AS skew, kurtosis(value) AS kurtosis,
    count(*) / 6.0 * (pow(avg(pow(z, 3)), 2) + pow(avg(pow(z, 4)) - 3, 2) / 4) AS moment_statistic
    FROM (SELECT value, (value - m) / s AS z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events))"""


@query(
    f"""WITH v AS (SELECT value AS x, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
    e AS (SELECT i, n, (i + 0.125) / (n + 0.25) AS p FROM (SELECT i, n FROM v UNION ALL SELECT DISTINCT 0, n FROM v)),
    d AS (SELECT i, n, exp(-z * z / 2) / sqrt(2 * pi()) AS f FROM (SELECT i, n, {_quantile_sql("p")} AS z FROM e)),
    s AS (SELECT i, (n + 0.25) * (lag(f) OVER (ORDER BY i) - f) AS score FROM d),
    w AS (SELECT count(*) AS n, pow(sum((x - (SELECT avg(x) FROM v)) * score), 2) / (var_pop(x) * count(*)) / sum(score * score) AS w
          FROM v JOIN s USING (i)),
    z AS (SELECT n, w, (ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM w)
    SELECT 'shapiro-francia' AS test, 'ok' AS status, n, round(w, 6) AS w, round(z, 3) AS z, z > 1.6448536269514722 AS significant,
           round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(moment_statistic, 4) AS moment_statistic
    FROM z, ({_MOMENTS})"""
)
def normality_test(t):
    """W and the moment test on all rows; p-values are unit-tested."""
    found = relate.normality_test(t.events, "value").drop("p_value", "moment_p_value")
    return found.withColumns(
        {c: F.round(c, d) for c, d in (("w", 6), ("z", 3), ("skew", 6), ("kurtosis", 6), ("moment_statistic", 4))}
    )


@query(
    """WITH v AS (SELECT l_quantity AS x FROM lineitem), n AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM v)
    SELECT 'ok' AS status, any_value(n) AS n, round(skewness(x), 6) AS skew, round(kurtosis(x), 6) AS kurtosis,
           round(any_value(n) / 6.0 * (pow(avg(pow((x - m) / s, 3)), 2) + pow(avg(pow((x - m) / s, 4)) - 3, 2) / 4), 3) AS moment_statistic
    FROM v, n"""
)
def normality_moments(t):
    """The moment test where few values fill all rows."""
    found = relate.normality_test(t.lineitem, "l_quantity")
    return found.select(
        "status", "n", F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"),
        F.round("moment_statistic", 3).alias("moment_statistic"),
    )


@query(
    """WITH g AS (SELECT l_linestatus AS level, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v
                 FROM lineitem GROUP BY l_linestatus),
    p AS (SELECT a.m - b.m AS gap, a.v / a.n AS e1, b.v / b.n AS e2, a.n AS n1, b.n AS n2
          FROM g a JOIN g b ON a.level < b.level)
    SELECT 'welch-t' AS test, 'ok' AS status, round(gap / sqrt(e1 + e2), 4) AS statistic,
           round(pow(e1 + e2, 2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 2) AS dof FROM p"""
)
def t_test(t):
    found = relate.t_test(t.lineitem, "l_extendedprice", "l_linestatus")
    return found.select("test", "status", F.round("statistic", 4).alias("statistic"), F.round("dof", 2).alias("dof"))


@query(
    """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v
                 FROM lineitem GROUP BY l_returnflag HAVING count(*) >= 2),
    s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS within FROM g)
    SELECT 'anova' AS test, 'ok' AS status, any_value(s.k) - 1 AS dof_between, CAST(any_value(s.n) - any_value(s.k) AS BIGINT) AS dof_within,
           round((sum(g.n * pow(g.m - s.grand, 2)) / (any_value(s.k) - 1)) / (any_value(s.within) / (any_value(s.n) - any_value(s.k))), 4) AS statistic
    FROM g, s"""
)
def anova_test(t):
    found = relate.anova_test(t.lineitem, "l_extendedprice", "l_returnflag")
    return found.select("test", "status", "dof_between", "dof_within", F.round("statistic", 4).alias("statistic"))


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab(t):
    return relate.crosstab(t.lineitem, "l_returnflag", "l_linestatus")


def _chi_sql(table: str, a: str, b: str, yates: bool) -> str:
    gap = "abs(coalesce(c.n, 0) - ra.n * rb.n / CAST(s.n AS DOUBLE))"
    gap = f"({gap} - least(0.5, {gap}))" if yates else gap
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
    ra AS (SELECT a, sum(n) AS n FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
    s AS (SELECT sum(n) AS n FROM c)
    SELECT 'chi-square' AS test, 'ok' AS status, round(sum(pow({gap}, 2) / (ra.n * rb.n / CAST(s.n AS DOUBLE))), 4) AS statistic,
           (count(DISTINCT ra.a) - 1) * (count(DISTINCT rb.b) - 1) AS dof
    FROM ra CROSS JOIN rb CROSS JOIN s LEFT JOIN c ON c.a = ra.a AND c.b = rb.b"""


@query(_chi_sql("labels", "quality", "toxic", True))
def chi_square_two_by_two(t):
    found = relate.chi_square_test(t.labels, "quality", "toxic")
    return found.select("test", "status", F.round("statistic", 4).alias("statistic"), "dof")


@query(_chi_sql("part", "p_brand", "p_type", False))
def chi_square_test(t):
    found = relate.chi_square_test(t.part, "p_brand", "p_type")
    return found.select("test", "status", F.round("statistic", 4).alias("statistic"), "dof")


@query(
    """SELECT n, round(m, 4) AS mean, round((m - 1.96 * s / sqrt(n)) / 10) * 10 AS low, round((m + 1.96 * s / sqrt(n)) / 10) * 10 AS high
    FROM (SELECT count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)"""
)
def confidence_interval(t):
    """Bounds to the nearest ten, where the t and the normal quantile agree; exact bounds are unit-tested."""
    found = relate.confidence_interval(t.lineitem, "l_extendedprice")
    return found.select(
        "n", "mean", (F.round(F.col("low") / 10) * 10).alias("low"), (F.round(F.col("high") / 10) * 10).alias("high")
    )


@query(
    """SELECT 'ok' AS status, count(*) AS n, 2.3 AS slope, CAST(1 AS DOUBLE) AS intercept, CAST(1 AS DOUBLE) AS r_squared,
    CAST(0 AS DOUBLE) AS std_err, CAST(0 AS DOUBLE) AS residual_mean FROM orders"""
)
def regression_on_a_line(t):
    """All rows on one line: rounding must not carry the correlation beyond 1."""
    table = t.orders.selectExpr("o_orderkey / 3 AS x", "2.3D * (o_orderkey / 3) + 1 AS y")
    found = relate.regression_diagnostics(table, "x", "y").drop("p_value", "residual_std")
    return found.withColumn("slope", F.col("slope").cast("decimal(2,1)"))


@query(
    """SELECT 'ok' AS status, count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept,
    round(regr_r2(y, x), 4) AS r_squared,
    round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 4) AS std_err,
    CAST(0 AS DOUBLE) AS residual_mean,
    round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 1)), 3) AS residual_std
    FROM (SELECT l_quantity AS x, l_extendedprice * l_quantity AS y FROM lineitem)"""
)
def regression_diagnostics(t):
    table = t.lineitem.selectExpr("l_quantity AS x", "l_extendedprice * l_quantity AS y")
    found = relate.regression_diagnostics(table, "x", "y").drop("p_value")
    return found.withColumn("residual_std", F.round("residual_std", 3))
