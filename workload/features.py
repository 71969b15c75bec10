"""Derived columns."""

from __future__ import annotations

from tablescope.operators import features
from workload.registry import query, rounded

_CALENDAR = (
    "CAST(year({c}) AS INT) AS {c}_year, CAST(month({c}) AS INT) AS {c}_month, "
    "CAST(isodow({c}) - 1 AS INT) AS {c}_day_of_week, CAST(isodow({c}) - 1 AS INT) AS day_of_week"
)
_SHIFTED = (
    "lag({c}, 1) OVER w AS {c}_lag_1, lag({c}, 2) OVER w AS {c}_lag_2, "
    "round(avg({c}) OVER (PARTITION BY {k} ORDER BY {o} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) "
    "AS {c}_rolling_mean_3"
)


@query(f"SELECT o_orderkey, o_orderdate, {_CALENDAR.format(c='o_orderdate')} FROM orders")
def calendar_features(t):
    return features.calendar_features(t.orders.select("o_orderkey", "o_orderdate"))


@query(
    f"""SELECT event_id, ts, user_id, value, {_SHIFTED.format(c='value', k='user_id', o='ts, event_id')}
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def lag_features(t):
    table = t.events.select("event_id", "ts", "user_id", "value")
    return rounded(features.lag_features(table, ["value"], ["ts", "event_id"], ["user_id"]), 6)


@query(
    f"""SELECT event_id, ts, value, {_SHIFTED.format(c='value', k='1', o='ts, event_id')}
        FROM events WINDOW w AS (ORDER BY ts, event_id)"""
)
def lag_features_split(t):
    """One series over the whole table, cut into blocks because it counts as a hot group."""
    table = t.events.select("event_id", "ts", "value")
    limits = {"hot_group_rows": 1_000, "block_rows": 2_500}
    return rounded(features.lag_features(table, ["value"], ["ts", "event_id"], **limits), 6)


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
              count(*) OVER (PARTITION BY l_returnflag) AS l_returnflag_freq,
              count(*) OVER (PARTITION BY l_linestatus) AS l_linestatus_freq FROM lineitem"""
)
def frequency_features(t):
    table = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return features.frequency_features(table)


@query(
    f"""SELECT event_id, ts, user_id, event_type, value, {_CALENDAR.format(c='ts')},
        count(*) OVER (PARTITION BY event_type) AS event_type_freq,
        {_SHIFTED.format(c='value', k='user_id', o='ts, event_id')}
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def engineer_features(t):
    table = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    made, _ = features.engineer_features(table, ["ts", "event_id"], ["user_id"], value_columns=["value"])
    return rounded(made, 6)
