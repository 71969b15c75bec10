"""Trend, calendar, decomposition, forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import timeseries
from workload.registry import query, rounded, texts

_TREND = """count(*) AS points,
  CASE WHEN count(*) < 5 THEN 'insufficient_data' WHEN regr_slope(y, i) > 0 THEN 'increasing'
       WHEN regr_slope(y, i) < 0 THEN 'decreasing' ELSE 'flat' END AS trend,
  CASE WHEN count(*) >= 5 THEN round(regr_slope(y, i), 4) + 0.0 END AS slope,
  CASE WHEN count(*) >= 5 THEN round(regr_slope(y, i) * count(*) / abs(avg(y)) * 100, 2) END AS pct_change"""


@query(
    f"""SELECT event_type, {_TREND} FROM (SELECT event_type, value AS y,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY event_type"""
)
def trend_direction(t):
    found = timeseries.trend_direction(t.events, "value", ["ts", "event_id"], ["event_type"])
    return found.withColumn("slope", F.col("slope") + 0.0)


@query(
    f"""SELECT o_custkey, {_TREND} FROM (SELECT o_custkey, o_totalprice AS y,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) GROUP BY o_custkey"""
)
def trend_per_customer(t):
    found = timeseries.trend_direction(t.orders, "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return found.withColumn("slope", F.col("slope") + 0.0)


@query(
    f"""SELECT {_TREND}, strftime(min(d), '%Y-%m-%d') AS "start", strftime(max(d), '%Y-%m-%d') AS "end"
        FROM (SELECT o_totalprice AS y, o_orderdate AS d,
              row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)"""
)
def time_series_summary(t):
    found = timeseries.time_series_summary(t.orders, "o_orderdate", "o_totalprice", ["o_orderkey"])
    return texts(found.withColumn("slope", F.col("slope") + 0.0), "start", "end")


# Daily means per supplier on a calendar without gaps, filled on straight lines.
_CALENDAR = """
  daily AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
  spans AS (SELECT l_suppkey, min(day) AS a, max(day) AS b FROM daily GROUP BY 1),
  calendar AS (SELECT l_suppkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
  gaps AS (SELECT c.l_suppkey, c.day, d.value FROM calendar c LEFT JOIN daily d USING (l_suppkey, day)),
  known AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER past AS day_a,
                   last_value(value IGNORE NULLS) OVER past AS a,
                   first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER future AS day_b,
                   first_value(value IGNORE NULLS) OVER future AS b
            FROM gaps
            WINDOW past AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   future AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT l_suppkey, day, coalesce(value, a + (b - a) * (day - day_a) / nullif(day_b - day_a, 0), a) AS value
             FROM known)"""


@query(f"WITH {_CALENDAR} SELECT l_suppkey, CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM gaps")
def resample_daily(t):
    found = timeseries.resample_daily(t.lineitem, "l_shipdate", "l_quantity", ["l_suppkey"])
    return texts(rounded(found, 6), "day")


@query(f"WITH {_CALENDAR} SELECT l_suppkey, CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM filled")
def interpolate_linear(t):
    gaps = timeseries.resample_daily(t.lineitem, "l_shipdate", "l_quantity", ["l_suppkey"])
    return texts(rounded(timeseries.interpolate_linear(gaps, "day", "value", ["l_suppkey"]), 6), "day")


@query(f"WITH {_CALENDAR} SELECT l_suppkey, CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM filled")
def daily_series(t):
    """Calendar and interpolation in one pass."""
    found = timeseries.daily_series(t.lineitem, "l_shipdate", "l_quantity", ["l_suppkey"])
    return texts(rounded(found, 6), "day")


@query("SELECT ts AS date, round(avg(value), 6) AS value FROM events GROUP BY ts")
def actuals_by_date(t):
    return rounded(timeseries.actuals_by_date(t.events, "ts", "value"), 6)


def _decompose_sql(m: int, key: str = "event_type") -> str:
    half = m // 2
    if m % 2:
        mean = f"avg(value) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    else:
        mean = (
            f"(sum(value) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) "
            f"- (lag(value, {half}) OVER w + lead(value, {half}) OVER w) / 2) / {m}"
        )
    return f"""WITH daily AS (
      SELECT {key} AS k, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1, 2),
    base AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k) AS n, {mean} AS mean
             FROM daily WINDOW w AS (PARTITION BY k ORDER BY day)),
    smooth AS (SELECT *, CASE WHEN i >= {half} AND i <= n - 1 - {half} THEN mean END AS t FROM base WHERE n >= {2 * m}),
    heads AS (SELECT k, regr_slope(t, i) AS b, regr_intercept(t, i) AS c FROM smooth
              WHERE i >= {half} AND i < least({half} + {m}, n - 1 - {half}) GROUP BY k),
    tails AS (SELECT k, regr_slope(t, i) AS b, regr_intercept(t, i) AS c FROM smooth
              WHERE i >= greatest({half}, n - 1 - {half} - {m}) AND i < n - 1 - {half} GROUP BY k),
    trended AS (SELECT s.k, s.day, s.value, s.i,
                CASE WHEN s.i < {half} THEN h.c + h.b * s.i WHEN s.i > s.n - 1 - {half} THEN l.c + l.b * s.i ELSE s.t END AS trend
                FROM smooth s JOIN heads h USING (k) JOIN tails l USING (k)),
    phases AS (SELECT k, i % {m} AS phase, avg(value - trend) AS p FROM trended GROUP BY 1, 2),
    centred AS (SELECT k, phase, p - avg(p) OVER (PARTITION BY k) AS s FROM phases),
    parts AS (SELECT t.k, CAST(day AS VARCHAR) AS day, round(value, 5) + 0.0 AS value, round(trend, 5) + 0.0 AS trend,
           round(s, 5) + 0.0 AS seasonal, round(value - trend - s, 5) + 0.0 AS resid
    FROM trended t JOIN centred c ON c.k = t.k AND c.phase = t.i % {m})"""


_BY_TYPE = " SELECT k AS event_type, day, value, trend, seasonal, resid FROM parts"


def _decomposed(t, period: int):
    found = timeseries.seasonal_decompose(t.events, "ts", "value", period, ["event_type"])
    parts = texts(rounded(found, 5), "day")
    return parts.withColumns({c: F.col(c) + 0.0 for c in ("value", "trend", "seasonal", "resid")})


@query(_decompose_sql(7) + _BY_TYPE)
def seasonal_decompose(t):
    return _decomposed(t, 7)


@query(_decompose_sql(4) + _BY_TYPE)
def seasonal_decompose_even(t):
    return _decomposed(t, 4)


@query()
def holt_winters_forecast(t):
    return timeseries.holt_winters_forecast(t.events, "ts", "value", 30, ["event_type"])


@query(
    """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS ds, round(avg(value), 6) AS yhat,
              round(avg(value), 6) AS yhat_lower, round(avg(value), 6) AS yhat_upper FROM events GROUP BY 1, 2"""
)
def forecast_history(t):
    """The history rows of a forecast carry the daily values."""
    found = timeseries.holt_winters_forecast(t.events, "ts", "value", 30, ["event_type"])
    return texts(rounded(found.filter("NOT is_forecast").drop("is_forecast"), 6), "ds")


@query()
def forecast_after(t):
    """One series per user."""
    last = t.events.agg(F.max("ts")).first()[0].date()
    forecast = timeseries.holt_winters_forecast(t.events, "ts", "value", 30, ["user_id"])
    return timeseries.forecast_after(forecast, last)
