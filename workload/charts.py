"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions import normal
from tablescope.operators import charts, isolation, timeseries, unsupervised
from workload.registry import query, rounded, texts, with_messy
from workload.series import _decompose_sql


def _bin_sql(column: str, table: str, bins: int) -> str:
    low, high = f"(SELECT min({column}) FROM {table})", f"(SELECT max({column}) FROM {table})"
    return f"CAST(least(floor(({column} - {low}) / (({high} - {low}) / {bins})), {bins - 1}) AS BIGINT)"


@query(
    f"""SELECT bin, round(a + bin * (b - a) / 40, 6) AS low, round(a + (bin + 1) * (b - a) / 40, 6) AS high, n
    FROM (SELECT {_bin_sql('value', 'events', 40)} AS bin, count(*) AS n FROM events GROUP BY 1),
         (SELECT min(value) AS a, max(value) AS b FROM events)"""
)
def histogram(t):
    return rounded(charts.histogram(t.events, "value"), 6)


@query(
    """WITH s AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS a, max(value) AS b FROM events),
    g AS (SELECT CAST(i AS INT) AS point, a + (b - a) * i / 199 AS x, h, n FROM s, generate_series(0, 199) t(i))
    SELECT point, round(any_value(x), 6) AS x,
           round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
    FROM g, events GROUP BY point"""
)
def kde(t):
    found = charts.kde(t.events, "value")
    return found.select("point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


_BOX = """q AS (SELECT {x} AS x, count(*) AS n, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median,
                  quantile_cont({y}, 0.75) AS q3 FROM {t} GROUP BY 1)"""


def _box_sql(table: str, x: str, y: str) -> str:
    inside = f"{y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""WITH {_BOX.format(x=x, y=y, t=table)}
    SELECT x, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
           round(min(CASE WHEN {inside} THEN {y} END), 6) AS whisker_low,
           round(max(CASE WHEN {inside} THEN {y} END), 6) AS whisker_high,
           round(median - 1.57 * (q3 - q1) / sqrt(n), 6) AS notch_low,
           round(median + 1.57 * (q3 - q1) / sqrt(n), 6) AS notch_high,
           count(CASE WHEN NOT ({inside}) THEN 1 END) AS outliers
    FROM {table} JOIN q ON q.x = {table}.{x} GROUP BY x, n, q1, median, q3"""


@query(_box_sql("events", "event_type", "value"))
def box_stats(t):
    return rounded(charts.box_stats(t.events, "event_type", "value"), 6)


@query(_box_sql("lineitem", "l_suppkey", "l_extendedprice"))
def box_stats_many_groups(t):
    return rounded(charts.box_stats(t.lineitem, "l_suppkey", "l_extendedprice"), 6)


@query(
    f"""WITH {_BOX.format(x='event_type', y='value', t='events')},
    s AS (SELECT event_type AS x, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h,
                 min(value) AS a, max(value) AS b FROM events GROUP BY 1),
    g AS (SELECT x, CAST(i AS INT) AS point, a + (b - a) * i / 199 AS value, h, n FROM s, generate_series(0, 199) t(i)),
    d AS (SELECT g.x, point, any_value(g.value) AS value,
                 sum(exp(-0.5 * pow((g.value - e.value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
          FROM g JOIN events e ON e.event_type = g.x GROUP BY g.x, point)
    SELECT d.x, point, round(value, 6) AS value, round(density, 8) AS density, round(q1, 6) AS q1,
           round(median, 6) AS median, round(q3, 6) AS q3 FROM d JOIN q ON q.x = d.x"""
)
def violin(t):
    found = charts.violin(t.events, "event_type", "value")
    shown = {c: F.round(c, 6) for c in ("value", "q1", "median", "q3")}
    return found.withColumns({**shown, "density": F.round("density", 8)})


@query(
    """SELECT value, round(sum(n) OVER (ORDER BY value) / CAST(sum(n) OVER () AS DOUBLE), 8) AS share
    FROM (SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1)"""
)
def ecdf(t):
    return rounded(charts.ecdf(t.lineitem, "l_extendedprice"), 8)


@query(
    """SELECT 9007199254740993 + o_orderkey AS value,
    round(row_number() OVER (ORDER BY o_orderkey) / CAST(count(*) OVER () AS DOUBLE), 8) AS share FROM orders"""
)
def ecdf_big_keys(t):
    """Whole numbers beyond 2^53 stay apart."""
    return rounded(charts.ecdf(t.orders.selectExpr("9007199254740993 + o_orderkey AS big"), "big"), 8)


@query(
    """SELECT row_number() OVER (ORDER BY value) AS position, round(value, 6) AS value,
    round(CASE WHEN row_number() OVER (ORDER BY value) = n THEN pow(0.5, 1.0 / n)
               WHEN row_number() OVER (ORDER BY value) = 1 THEN 1 - pow(0.5, 1.0 / n)
               ELSE (row_number() OVER (ORDER BY value) - 0.3175) / (n + 0.365) END, 8) AS probability
    FROM events, (SELECT count(*) AS n FROM events)"""
)
def qq_points(t):
    found = charts.qq(t.events, "value").select("position", "value", "probability")
    return found.withColumns({"value": F.round("value", 6), "probability": F.round("probability", 8)})


def _horner(coefficients: list[float], x: str) -> str:
    text = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


_QQ_LINE = f"""WITH points AS (
  SELECT value, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
                ELSE (i - 0.3175) / (n + 0.365) END AS p
  FROM (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events)),
places AS (SELECT value, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) AS t FROM points),
scores AS (SELECT value, CASE
    WHEN abs(q) <= 0.425 THEN q * {_horner(normal.CENTRE_TOP, 'c')} / {_horner(normal.CENTRE_BOTTOM, 'c')}
    WHEN t <= 5 THEN sign(q) * {_horner(normal.MIDDLE_TOP, '(t - 1.6)')} / {_horner(normal.MIDDLE_BOTTOM, '(t - 1.6)')}
    ELSE sign(q) * {_horner(normal.FAR_TOP, '(t - 5)')} / {_horner(normal.FAR_BOTTOM, '(t - 5)')} END AS z FROM places)
SELECT round(regr_slope(value, z), 6) AS slope, round(regr_intercept(value, z), 6) AS intercept, count(*) AS n FROM scores"""


@query(_QQ_LINE)
def qq_line(t):
    return rounded(charts.qq_line(t.events, "value"), 6)


@query("SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def scatter(t):
    return charts.scatter(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    """SELECT l_returnflag AS color, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept FROM lineitem GROUP BY 1"""
)
def trend_lines(t):
    return rounded(charts.trend_lines(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag"), 5)


@query("SELECT o_totalprice, o_custkey, o_orderkey, o_orderstatus FROM orders")
def bubble(t):
    return charts.bubble(t.orders, "o_totalprice", "o_custkey", "o_orderkey", "o_orderstatus")


@query(
    f"""SELECT {_bin_sql('l_quantity', 'lineitem', 30)} AS x_bin, {_bin_sql('l_extendedprice', 'lineitem', 30)} AS y_bin,
    count(*) AS n FROM lineitem GROUP BY 1, 2"""
)
def density_2d(t):
    return charts.density_2d(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {_bin_sql(a, 'lineitem', 30)} AS a_bin, {_bin_sql(b, 'lineitem', 30)} AS b_bin, "
        f"count(*) AS n FROM lineitem GROUP BY 3, 4"
        for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_suppkey"), ("l_extendedprice", "l_suppkey")]
    )
)
def pair_matrix(t):
    return charts.pair_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_suppkey"])


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CAST(1 AS DOUBLE) AS r" if a == b else
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) + 0.0 AS r FROM part"
        for a in ("p_partkey", "p_size", "p_retailprice")
        for b in ("p_partkey", "p_size", "p_retailprice")
    )
)
def correlation_heatmap(t):
    return charts.correlation_heatmap(t.part).withColumn("r", F.col("r") + 0.0)


@query(with_messy(
    "SELECT order_id, amount, customer_id, status FROM messy_orders "
    "WHERE amount IS NOT NULL"
))
def parallel_coordinates(t):
    return charts.parallel_coordinates(t.messy_orders, ["order_id", "amount", "customer_id"], "status")


@query(
    """SELECT p_type AS category, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice
    FROM part GROUP BY 1 ORDER BY 1 LIMIT 6"""
)
def radar(t):
    return rounded(charts.radar(t.part, "p_type", ["p_size", "p_retailprice"]), 6)


@query("SELECT l_suppkey AS x, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1 ORDER BY avg(l_extendedprice) DESC, 1 LIMIT 30")
def bar(t):
    return rounded(charts.bar(t.lineitem, "l_suppkey", "l_extendedprice"), 4)


@query('SELECT l_returnflag AS x, l_linestatus AS "group", round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1, 2')
def grouped_bar(t):
    return rounded(charts.grouped_bar(t.lineitem, "l_returnflag", "l_extendedprice", "l_linestatus"), 4)


@query('SELECT l_returnflag AS x, l_linestatus AS "group", round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2')
def stacked_bar(t):
    return rounded(charts.stacked_bar(t.lineitem, "l_returnflag", "l_extendedprice", "l_linestatus"), 2)


@query("SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def count_plot(t):
    return charts.count_plot(t.lineitem, "l_suppkey")


@query(
    """SELECT name, round(value, 2) AS value, round(value / sum(value) OVER (), 6) AS share
    FROM (SELECT c_mktsegment AS name, sum(c_acctbal) AS value FROM customer GROUP BY 1)"""
)
def pie(t):
    found = charts.pie(t.customer, "c_mktsegment", "c_acctbal")
    return found.select("name", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"))


@query(
    """SELECT name, value, round(value / CAST(sum(value) OVER () AS DOUBLE), 6) AS share
    FROM (SELECT o_orderstatus AS name, count(*) AS value FROM orders GROUP BY 1)"""
)
def donut(t):
    return rounded(charts.pie(t.orders, "o_orderstatus"), 6)


@query(
    """SELECT CAST(3 - (grouping(l_returnflag) + grouping(l_linestatus) + grouping(l_linenumber)) AS INT) AS level,
    l_returnflag, l_linestatus, l_linenumber, round(sum(l_extendedprice), 2) AS value
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)"""
)
def hierarchy(t):
    return rounded(charts.hierarchy(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice"), 2)


@query("SELECT o_orderdate, o_totalprice FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL")
def line(t):
    return charts.line(t.orders, "o_orderdate", "o_totalprice")


@query(
    """SELECT date_trunc('month', o_orderdate) AS bucket, o_orderstatus AS color, round(avg(o_totalprice), 4) AS value, count(*) AS n
    FROM orders GROUP BY 1, 2"""
)
def line_means(t):
    return rounded(charts.line_means(t.orders, "o_orderdate", "o_totalprice", "month", "o_orderstatus"), 4)


@query("SELECT ts, value, event_type FROM events")
def area(t):
    return charts.area(t.events, "ts", "value", "event_type")


@query(
    """SELECT event_type, ts, event_id, value,
    round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling
    FROM events"""
)
def rolling_average(t):
    found = charts.rolling_average(t.events, "ts", "value", 7, ["event_id"], ["event_type"])
    return found.withColumn("rolling", F.round("rolling", 6))


@query(with_messy(" UNION ALL ".join(
    f"SELECT {_bin_sql('order_id', 'messy_orders', 50)} AS bucket, '{c}' AS \"column\", count(*) AS n_rows, "
    f"count(*) - count({c}) AS n_missing FROM messy_orders GROUP BY 1"
    for c in ("customer_id", "revenue_txt", "amount", "priority", "status", "order_date_txt", "sparse_col", "constant_col")
)))
def missing_map(t):
    return charts.missing_map(t.messy_orders, "order_id")


@query(
    """SELECT * FROM (
      SELECT CAST(1 AS INT) AS ord, 'order_id by status' AS title, 'bar' AS kind, 'status' AS x, 'order_id' AS y, NULL AS color, 0 AS d
      UNION ALL SELECT 2, 'Rows per status', 'count', 'status', NULL, NULL, 0
      UNION ALL SELECT 3, 'order_id along placed', 'line', 'placed', 'order_id', NULL, 0
      UNION ALL SELECT 4, 'order_id against price', 'scatter', 'order_id', 'price', 'status', 0
      UNION ALL SELECT 5, 'Values of order_id', 'histogram', 'order_id', NULL, NULL, 0
      UNION ALL SELECT 6, 'price by status', 'box', 'status', 'price', NULL, 0)
    WHERE (SELECT count(DISTINCT o_orderstatus) < count(DISTINCT o_orderpriority) FROM orders)""".replace(", 0 AS d", "").replace(", 0\n", "\n").replace(", 0)", ")")
)
def auto_charts(t):
    table = t.orders.selectExpr(
        "o_orderkey AS order_id", "o_orderstatus AS status", "o_orderpriority AS priority",
        "o_totalprice AS price", "o_orderdate AS placed",
    )
    return charts.auto_charts(table)


@query(
    """SELECT 'histogram' AS kind, 'value' AS subject, m.metric, round(m.value, 4) AS value, m.label FROM (
      SELECT 'min' AS metric, min(value) AS value, NULL AS label FROM events
      UNION ALL SELECT 'max', max(value), NULL FROM events
      UNION ALL SELECT 'mean', avg(value), NULL FROM events
      UNION ALL SELECT 'skew', skewness(value), CASE WHEN skewness(value) > 0.5 THEN 'right-skewed'
        WHEN skewness(value) < -0.5 THEN 'left-skewed' ELSE 'symmetric' END FROM events) m
    UNION ALL
    SELECT 'bar', 'o_totalprice', m.metric, round(m.value, 4), m.label FROM (
      SELECT 'leader' AS metric, max(v) AS value, arg_max(p, v) AS label FROM (SELECT o_orderpriority AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1)
      UNION ALL SELECT 'gap', max(v) - min(v), arg_min(p, v) FROM (SELECT o_orderpriority AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1)) m
    UNION ALL
    SELECT 'scatter', 'l_extendedprice, l_quantity', 'r', round(r, 4),
      CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END
      || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END
    FROM (SELECT corr(l_extendedprice, l_quantity) AS r FROM lineitem)
    UNION ALL SELECT 'missing', 'table', 'missing_pct', CAST(round(100.0 * (count(*) - count(value)) / (5 * count(*)), 1) AS DOUBLE), NULL FROM events"""
)
def chart_insights(t):
    found = charts.chart_insight(t.events, "histogram", "value")
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    for part in (
        charts.chart_insight(t.orders, "bar", "o_orderpriority", "o_totalprice"),
        charts.chart_insight(t.lineitem, "scatter", "l_extendedprice", "l_quantity"),
        charts.chart_insight(events, "missing"),
    ):
        found = found.unionByName(part)
    return rounded(found.drop("message"), 4)


@query()
def pca_points(t):
    table = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return charts.pca_points(unsupervised.pca(table, 2).scores, "l_returnflag")


@query()
def cluster_points(t):
    found = unsupervised.kmeans(t.part.select("p_size", "p_retailprice"), 3)
    return charts.cluster_points(found.labelled, "p_size", "p_retailprice")


@query()
def anomaly_points(t):
    flagged = isolation.detect_anomalies(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return charts.anomaly_points(flagged, "o_orderkey", "o_totalprice")


@query(
    _decompose_sql(7, "1")
    + " UNION ALL ".join(
        f" SELECT day, '{c}' AS component, {c} AS value FROM parts" for c in ("value", "trend", "seasonal", "resid")
    )
)
def seasonal_lines(t):
    parts = timeseries.seasonal_decompose(t.events, "ts", "value", 7)
    lines = texts(rounded(charts.seasonal_lines(parts), 5), "day")
    return lines.withColumn("value", F.col("value") + 0.0)


@query()
def forecast_lines(t):
    """One series per user."""
    return charts.forecast_lines(timeseries.holt_winters_forecast(t.events, "ts", "value", 30, ["user_id"]))
