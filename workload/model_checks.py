"""Models whose result follows from the data: exact lines, steps, groups far apart, planted rows.

A fitted model has no SQL counterpart, but on such data SQL knows what every correct fit must return.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import charts, isolation, supervised, timeseries, unsupervised
from workload.registry import query, rounded, texts

# --- series on a straight line: y grows by a quarter a day from the first order on


def _line_of_orders(t):
    first = t.orders.agg(F.min("o_orderdate")).first()[0].date()
    return t.orders.select("o_orderdate", (5 + 0.25 * F.datediff("o_orderdate", F.lit(first))).alias("y"))


_LINE_AHEAD = """SELECT strftime(CAST(b AS DATE) + CAST(i AS INTEGER), '%Y-%m-%d') AS ds,
    round(5 + 0.25 * (date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) + i), 4) AS yhat
    FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders), range({first}, {last}) t(i)"""


@query(
    f"""SELECT ds, yhat, yhat AS yhat_lower, yhat AS yhat_upper, ds > (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS is_forecast
    FROM ({_LINE_AHEAD.format(first="-date_diff('day', a, b)", last=22)})""".replace(
        "range(-date_diff('day', a, b), 22) t(i)",
        "range(-(SELECT date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) FROM orders), 22) t(i)",
    )
)
def forecast_of_a_line(t):
    """History and forecast of an exact line, drawn as lines."""
    found = charts.forecast_lines(timeseries.holt_winters_forecast(_line_of_orders(t), "o_orderdate", "y", 21))
    return texts(rounded(found, 4), "ds")


@query(_LINE_AHEAD.format(first=8, last=31))
def forecast_after_a_day(t):
    """The rows of a forecast behind a day a week after the last actual."""
    last = t.orders.agg(F.date_add(F.to_date(F.max("o_orderdate")), 7)).first()[0]
    forecast = timeseries.holt_winters_forecast(_line_of_orders(t), "o_orderdate", "y", 30)
    return texts(rounded(timeseries.forecast_after(forecast, last).select("ds", "yhat"), 4), "ds")


# --- supervised


@query(
    """SELECT 'regression' AS task, 'price' AS target, 'linear_regression' AS model, 'ok' AS status, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS mae,
    0.0::DOUBLE AS rmse, 1.0::DOUBLE AS cv_mean, 0.0::DOUBLE AS cv_std, true AS is_best
    FROM part HAVING regr_r2(2.5 * p_size + 7, p_size) > 0.999999"""
)
def auto_train_on_a_line(t):
    """The target is a straight line of a feature: the linear model is exact in every fold."""
    table = t.part.selectExpr("p_size", "p_type", "CAST(2.5 * p_size + 7 AS DOUBLE) AS price")
    results = supervised.auto_train(table, "price").results
    return results.where("model = 'linear_regression'").drop("accuracy", "f1").withColumn("mae", F.col("mae") + 0.0)


@query(
    """SELECT 'classification' AS task, 'random_forest' AS model, 'ok' AS status, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1,
    1.0::DOUBLE AS cv_mean, 0.0::DOUBLE AS cv_std FROM part HAVING count(DISTINCT p_size % 7 < 3) = 2"""
)
def auto_train_on_steps(t):
    """The class changes with the size many times: trees that grow to the end find every step."""
    table = t.part.selectExpr("p_size", "IF(p_size % 7 < 3, 'low', 'high') AS step")
    results = supervised.auto_train(table, "step").results
    return results.where("model = 'random_forest'").select("task", "model", "status", "accuracy", "f1", "cv_mean", "cv_std")


@query("SELECT 'p_size' AS feature, 1 AS place FROM part HAVING max(p_size) > 25 AND min(p_size) <= 25")
def importance_of_a_step(t):
    """The class depends on one of three features."""
    table = t.part.selectExpr("p_size", "p_retailprice", "p_partkey % 97 AS noise", "IF(p_size > 25, 'a', 'b') AS step")
    trained = supervised.auto_train(table, "step", trees=20)
    first = charts.importance_bars(trained.importance, 1)
    return first.select("feature", F.lit(1).alias("place"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


@query(
    f"""WITH r AS (SELECT l_extendedprice AS y, 1000 * l_quantity AS p FROM lineitem),
    c AS (SELECT {_STATUS} AS y, o_custkey % 3 AS p FROM orders),
    k AS (SELECT y, count(*) AS n, sum(CAST(y = p AS INTEGER)) AS hit, (SELECT count(*) FROM c b WHERE b.p = c.y) AS said FROM c GROUP BY y)
    SELECT 'r2' AS metric, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS value FROM r
    UNION ALL SELECT 'mae', round(avg(abs(y - p)), 6) FROM r
    UNION ALL SELECT 'rmse', round(sqrt(avg(pow(y - p, 2))), 6) FROM r
    UNION ALL SELECT 'accuracy', round(avg(CAST(y = p AS INTEGER)), 6) FROM c
    UNION ALL SELECT 'f1', round(sum(n * CASE WHEN hit = 0 THEN 0 ELSE 2.0 * hit / (n + said) END) / sum(n), 6) FROM k"""
)
def model_metrics(t):
    """The metrics of given predictions."""
    numbers = t.lineitem.selectExpr("l_extendedprice AS _label", "CAST(1000 * l_quantity AS DOUBLE) AS _prediction")
    classes = t.orders.selectExpr(f"CAST({_STATUS} AS DOUBLE) AS _label", "CAST(o_custkey % 3 AS DOUBLE) AS _prediction")
    found = supervised.evaluate(numbers, supervised.REGRESSION) | supervised.evaluate(classes, supervised.CLASSIFICATION)
    return t.spark.createDataFrame([(m, round(v, 6)) for m, v in found.items()], "metric string, value double")


# --- components


def _components_sql(columns: list[str], table: str, k: int) -> str:
    """The first principal components by squaring the correlation matrix, deflated after each."""
    n = len(columns)
    cells = ", ".join(f"corr({a}, {b})" for a in columns for b in columns)
    product = f"[list_sum([m[(x // {n}) * {n} + j + 1] * m[j * {n} + (x % {n}) + 1] FOR j IN range({n})]) FOR x IN range({n * n})]"
    parts = [f"m0 AS (SELECT [{cells}] AS m FROM {table})"]
    for c in range(k):
        parts += [
            f"p{c}(i, m) AS (SELECT 0, m FROM m{c} UNION ALL SELECT i + 1, [v / list_max([abs(w) FOR w IN s]) FOR v IN s] "
            f"FROM (SELECT i, {product} AS s FROM p{c} WHERE i < 50))",
            f"d{c} AS (SELECT m, list_position([m[x * {n} + x + 1] FOR x IN range({n})], list_max([m[x * {n} + x + 1] FOR x IN range({n})])) - 1 AS j "
            f"FROM p{c} WHERE i = 50)",
            f"u{c} AS (SELECT [m[x * {n} + j + 1] / sqrt(list_sum([pow(m[y * {n} + j + 1], 2) FOR y IN range({n})])) FOR x IN range({n})] AS v FROM d{c})",
            f"l{c} AS (SELECT v, list_sum([v[x // {n} + 1] * v[x % {n} + 1] * a.m[x + 1] FOR x IN range({n * n})]) AS size FROM u{c}, m{c} a)",
            f"m{c + 1} AS (SELECT [a.m[x + 1] - size * v[x // {n} + 1] * v[x % {n} + 1] FOR x IN range({n * n})] AS m FROM l{c}, m{c} a)",
        ]
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", 'PC{c + 1}' AS component, round(v[{i + 1}] * "
        f"CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END, 3) + 0.0 AS loading FROM l{c}"
        for i, name in enumerate(columns)
        for c in range(k)
    )
    return f"WITH RECURSIVE {', '.join(parts)} {rows}"


_AMOUNTS = ["l_quantity", "l_extendedprice", "amount", "tax"]
_AMOUNTS_SQL = (
    "(SELECT l_quantity, l_extendedprice, l_quantity * l_extendedprice AS amount, l_extendedprice * l_tax AS tax FROM lineitem)"
)


@query(_components_sql(_AMOUNTS, _AMOUNTS_SQL, 2))
def pca_of_amounts(t):
    """Loadings of the first two components of four related columns."""
    table = t.lineitem.selectExpr(
        "l_quantity", "l_extendedprice", "l_quantity * l_extendedprice AS amount", "l_extendedprice * l_tax AS tax"
    )
    found = unsupervised.pca(table, 2).loadings
    return found.withColumn("loading", F.col("loading") + 0.0)


@query(
    """WITH z AS (SELECT l_returnflag, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
                        (l_quantity * l_extendedprice - avg(l_quantity * l_extendedprice) OVER ())
                          / stddev_pop(l_quantity * l_extendedprice) OVER () AS b FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(sum((a + b) / sqrt(2)), 3) + 0.0 AS first, round(sum(pow(a - b, 2) / 2), 3) AS second FROM z GROUP BY 1"""
)
def pca_points_of_two_columns(t):
    """Two related columns: their sum and their difference, but for a sign."""
    table = t.lineitem.selectExpr("l_quantity", "l_quantity * l_extendedprice AS amount", "l_returnflag")
    points = charts.pca_points(unsupervised.pca(table, 2, ["l_quantity", "amount"]).scores, "l_returnflag")
    return points.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), (F.round(F.sum("PC1"), 3) + 0.0).alias("first"), F.round(F.sum(F.pow("PC2", F.lit(2.0))), 3).alias("second")
    )


# --- clusters: three groups of customers, far apart

_GROUPS = ["c_nationkey % 3 * 100 + c_acctbal / 10000 AS x", "c_nationkey % 3 * -50 + c_custkey % 7 / 10.0 AS y"]
_GROUPS_SQL = (
    "(SELECT c_nationkey % 3 AS g, c_nationkey % 3 * 100 + c_acctbal / 10000 AS x, c_nationkey % 3 * -50 + c_custkey % 7 / 10.0 AS y FROM customer)"
)


def _groups(t):
    return t.customer.selectExpr(_GROUPS[0], f"CAST({_GROUPS[1].split(' AS ')[0]} AS DOUBLE) AS y")


@query(f"SELECT count(*) AS n, round(min(x), 4) AS x_from, round(max(x), 4) AS x_to, round(sum(y), 3) + 0.0 AS y_sum FROM {_GROUPS_SQL} GROUP BY g")
def kmeans_of_groups(t):
    """Groups far apart are the clusters, as points of a chart."""
    found = unsupervised.kmeans(_groups(t), 3)
    points = charts.cluster_points(found.labelled, "x", "y")
    return points.groupBy("cluster").agg(
        F.count("*").alias("n"), F.round(F.min("x"), 4).alias("x_from"), F.round(F.max("x"), 4).alias("x_to"),
        (F.round(F.sum("y"), 3) + 0.0).alias("y_sum"),
    ).drop("cluster")


@query(
    f"""WITH z AS (SELECT row_number() OVER () AS i, g, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y
                  FROM {_GROUPS_SQL}),
    d AS (SELECT a.i, a.g AS own, b.g AS g, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS s, count(*) AS n FROM z a, z b GROUP BY a.i, a.g, b.g),
    m AS (SELECT i, max(CASE WHEN g = own THEN s / (n - 1) END) AS inside, min(CASE WHEN g <> own THEN s / n END) AS outside FROM d GROUP BY i)
    SELECT CAST((SELECT count(DISTINCT g) FROM z) AS INTEGER) AS k, round(avg((outside - inside) / greatest(outside, inside)), 4) AS silhouette, true AS is_best FROM m"""
)
def auto_k_of_groups(t):
    """The number of groups is found, with its silhouette (exact up to 2 000 rows)."""
    return unsupervised.auto_k(_groups(t)).where("is_best").select("k", "silhouette", "is_best")


# --- anomalies

_SPIKES_SQL = """WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 40 ELSE o_totalprice END AS x FROM orders),
    q AS (SELECT quantile_cont(x, 0.5) AS m, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) * 0.7413 AS s, count(*) AS n FROM v)"""


def _spiked(t):
    return t.orders.selectExpr("o_orderkey", "IF(o_orderkey % 50 = 0, o_totalprice * 40, o_totalprice) AS x")


@query(f"{_SPIKES_SQL} SELECT k AS o_orderkey, round(x, 4) AS x, true AS is_anomaly FROM v, q WHERE abs(x - m) / s > 3")
def anomaly_points_of_spikes(t):
    """Among the anomalies, those with a spike are known exactly."""
    flagged = isolation.detect_anomalies(_spiked(t), ["x"])
    points = charts.anomaly_points(flagged, "o_orderkey", "x").where("anomaly_reason LIKE '%univariate spike%'")
    return points.select("o_orderkey", F.round("x", 4).alias("x"), "is_anomaly")


@query(
    f"""{_SPIKES_SQL} SELECT n, true AS share_is_kept, CAST(1 AS BIGINT) AS planted, true AS planted_found, true AS planted_is_extreme FROM q"""
)
def isolation_of_a_planted_row(t):
    """At most the wanted share is isolated, nearly all of it, and a row far from all others comes first."""
    planted = t.spark.range(1).selectExpr("-1L AS o_orderkey", "1e9D AS x")
    flagged = isolation.isolation_forest(_spiked(t).unionByName(planted), ["x"])
    facts = flagged.agg(
        (F.count("*") - 1).alias("n"),
        F.count_if("is_isolated").alias("found"),
        F.count_if(F.col("o_orderkey") == -1).alias("planted"),
        F.bool_or(F.when(F.col("o_orderkey") == -1, F.col("is_isolated"))).alias("planted_found"),
        (F.max(F.when(F.col("o_orderkey") == -1, F.col("isolation_score"))) >= F.max("isolation_score") - 0.05).alias("planted_is_extreme"),
    )
    share = F.col("found") / F.col("n")
    return facts.select("n", ((share <= 0.051) & (share > 0.03)).alias("share_is_kept"), "planted", "planted_found", "planted_is_extreme")
