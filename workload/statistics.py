"""Descriptive statistics and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import describe, isolation, outliers
from workload.registry import query, rounded, with_messy

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def stats_sql(table: str, columns: list[str], digits: int = 6) -> str:
    parts = []
    for c in columns:
        measures = {
            "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
            "q25": f"quantile_cont({c}, 0.25)", "median": f"quantile_cont({c}, 0.5)",
            "q75": f"quantile_cont({c}, 0.75)", "max": f"max({c})", "skew": f"skewness({c})",
            "kurtosis": f"kurtosis({c})", "iqr": f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
            "mad": f"(SELECT avg(abs({c} - (SELECT avg({c}) FROM {table}))) FROM {table})",
        }
        shown = ", ".join(f"round({e}, {digits}) AS {n}" for n, e in measures.items())
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, {shown}, "
            f"CAST(round(100.0 * (count(*) - count({c})) / count(*), 1) AS DOUBLE) AS missing_pct FROM {table}"
        )
    return " UNION ALL ".join(parts)


@query(stats_sql("lineitem", LINE))
def descriptive_stats(t):
    return describe.descriptive_stats(t.lineitem, LINE, digits=6)


@query(with_messy(stats_sql("messy_orders", ["amount"], 4)))
def descriptive_stats_with_gaps(t):
    return describe.descriptive_stats(t.messy_orders, ["amount"], digits=4)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 6) AS skew, "
        f"round(kurtosis({c}), 6) AS kurtosis FROM {table}"
        for table, columns in (("lineitem", LINE), ("events", ["value"]))
        for c in columns
    )
)
def skew_and_kurtosis(t):
    line = describe.skew_table(t.lineitem, LINE)
    return rounded(line.unionByName(describe.skew_table(t.events, ["value"])), 6)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(abs({c} - m)), 6) AS mad "
        f"FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"
        for c in LINE
    )
)
def mean_absolute_deviation(t):
    return rounded(describe.mad_table(t.lineitem, LINE), 6)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 2) AS q25, round(quantile_cont({c}, 0.5), 2) AS median, "
        f"round(quantile_cont({c}, 0.75), 2) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM part"
        for c in ("p_size",)
    )
)
def describe_overview(t):
    return describe.describe(t.part, ["p_size"])


@query(
    " UNION ALL ".join(
        f"SELECT CAST({k} AS INT) AS lag, round(corr(value, earlier), 6) AS autocorrelation "
        f"FROM (SELECT value, lag(value, {k}) OVER (ORDER BY ts, event_id) AS earlier FROM events)"
        for k in (1, 2, 3)
    )
)
def autocorrelation(t):
    return rounded(describe.autocorrelation(t.events, "value", ["ts", "event_id"]), 6)


@query(
    " UNION ALL ".join(
        f"""SELECT event_type, CAST({k} AS INT) AS lag, round(corr(value, earlier), 6) AS autocorrelation
        FROM (SELECT event_type, value,
                     lag(value, {k}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS earlier FROM events)
        GROUP BY event_type"""
        for k in (1, 7)
    )
)
def autocorrelation_by_type(t):
    found = describe.autocorrelation(t.events, "value", ["ts", "event_id"], [1, 7], ["event_type"])
    return rounded(found, 6)


def _outliers_sql(table: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, "
        f"count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers, "
        f"CAST(round(100.0 * count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) "
        f"/ count({c}), 2) AS DOUBLE) AS pct, round(any_value(q1 - 1.5 * (q3 - q1)), 2) AS lower_bound, "
        f"round(any_value(q3 + 1.5 * (q3 - q1)), 2) AS upper_bound "
        f"FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})"
    )


@query(with_messy(" UNION ALL ".join(_outliers_sql("messy_orders", c) for c in ("amount", "customer_id"))))
def outlier_summary(t):
    return rounded(outliers.outlier_summary(t.messy_orders, ["amount", "customer_id"]), 2)


@query(with_messy(
    """WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2,
                        quantile_cont(amount, 0.75) AS q3 FROM messy_orders)
    SELECT order_id, 'amount' AS spike_column, round(amount, 2) AS value,
           round(abs(amount - q2) / ((q3 - q1) * 0.7413), 4) AS z
    FROM messy_orders, q WHERE abs(amount - q2) / ((q3 - q1) * 0.7413) > 3"""
))
def robust_z_flags(t):
    flagged = outliers.robust_z_flags(t.messy_orders, ["amount", "customer_id"]).filter("is_spike")
    cells = flagged.select("order_id", F.inline("spikes")).withColumnRenamed("column", "spike_column")
    return cells.select("order_id", "spike_column", F.round("value", 2).alias("value"), F.round("z", 4).alias("z"))


@query(with_messy(
    """WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2,
                        quantile_cont(amount, 0.75) AS q3 FROM messy_orders),
    f AS (SELECT coalesce(abs(amount - q2) / ((q3 - q1) * 0.7413) > 3, false) AS flag FROM messy_orders, q)
    SELECT count(CASE WHEN flag THEN 1 END) AS anomalies, count(CASE WHEN NOT flag THEN 1 END) AS normal,
           CAST(round(100.0 * count(CASE WHEN flag THEN 1 END) / count(*), 1) AS DOUBLE) AS rate_pct FROM f"""
))
def anomaly_rate(t):
    return outliers.anomaly_rate(outliers.robust_z_flags(t.messy_orders, ["amount"]), "is_spike")


@query()
def isolation_forest(t):
    """Values of two columns and their isolation; no SQL can grow the trees."""
    table = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return isolation.isolation_forest(table, ["l_quantity", "l_extendedprice"])


@query()
def detect_anomalies(t):
    return isolation.detect_anomalies(t.messy_orders.select("order_id", "amount", "customer_id"), ["amount", "customer_id"])
