"""Descriptive statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import clean_number, col, numeric_cols, pearson, require_numeric, rows
from tablescope.plans.ordered import over_order
from tablescope.plans.quantiles import cut_aggregates, quantiles

_STATS_SCHEMA = (
    "column string, count long, mean double, std double, min double, q25 double, median double, "
    "q75 double, max double, skew double, kurtosis double, missing_pct double, iqr double, mad double"
)


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """One scan: rows, count, mean, std, min, max and corrected shape of each column."""
    return _moments_and(df, columns, [])[0]


def _moments_and(df: DataFrame, columns: list[str], more: list[Column]) -> tuple[dict[str, dict], Row | None]:
    """The moments, and the row of the scan, which also has the aggregates in ``more``."""
    if not columns:
        return {}, None
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        value = clean_number(name)
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
            F.skewness(value).alias(f"skew{i}"),
            F.kurtosis(value).alias(f"kurt{i}"),
        ]
    row = df.agg(*aggregates, *more).first()
    found = {}
    for i, name in enumerate(columns):
        n = row[f"n{i}"]
        found[name] = {
            "rows": row["rows"],
            "count": n,
            "mean": row[f"mean{i}"],
            "std": row[f"std{i}"],
            "min": row[f"min{i}"],
            "max": row[f"max{i}"],
            "skew": corrected_skew(row[f"skew{i}"], n),
            "kurtosis": corrected_kurtosis(row[f"kurt{i}"], n),
        }
    return found, row


_QUARTILES = [0.25, 0.5, 0.75]


def _moments_and_quartiles(df: DataFrame, columns: list[str]) -> tuple[dict[str, dict], dict[str, list[float | None]]]:
    """The scan for the moments also sketches where the quartiles lie."""
    shape, row = _moments_and(df, columns, cut_aggregates(columns, _QUARTILES))
    counts = {c: shape[c]["count"] for c in columns}
    cuts = {c: row[f"s{i}"] or [] for i, c in enumerate(columns)}
    return shape, quantiles(df, columns, _QUARTILES, counts, cuts)


def corrected_skew(population: float | None, n: int) -> float | None:
    """Bias-corrected sample skewness; 0 for a constant column, as is usual for tables."""
    if n < 3:
        return None
    if population is None or math.isnan(population):
        return 0.0
    return population * math.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(population: float | None, n: int) -> float | None:
    """Bias-corrected sample excess kurtosis."""
    if n < 4:
        return None
    if population is None or math.isnan(population):
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)


def mean_absolute_deviation(df: DataFrame, means: dict[str, float | None]) -> dict[str, float | None]:
    """Mean distance from the mean, in one scan for all columns."""
    names = [c for c, m in means.items() if m is not None]
    if not names:
        return {c: None for c in means}
    row = df.agg(
        *[F.avg(F.abs(clean_number(c) - F.lit(means[c]))).alias(f"d{i}") for i, c in enumerate(names)]
    ).first()
    return {c: None for c in means} | {c: row[f"d{i}"] for i, c in enumerate(names)}


def _rounded(value: float | None, digits: int) -> float | None:
    return None if value is None else round(value, digits)


def descriptive_stats(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """One row per numeric column; empty without numeric columns."""
    names = numeric_cols(df) if columns is None else columns
    shape, spread = _moments_and_quartiles(df, names)
    mad = mean_absolute_deviation(df, {c: shape[c]["mean"] for c in names})
    data = []
    for c in names:
        s = shape[c]
        q25, q50, q75 = spread[c]
        iqr = None if q25 is None else q75 - q25
        missing = round(100.0 * (s["rows"] - s["count"]) / s["rows"], 1) if s["rows"] else 0.0
        data.append(
            (c, s["count"])
            + tuple(
                _rounded(v, digits)
                for v in (s["mean"], s["std"], s["min"], q25, q50, q75, s["max"], s["skew"], s["kurtosis"])
            )
            + (missing, _rounded(iqr, digits), _rounded(mad[c], digits))
        )
    return rows(df.sparkSession, data, _STATS_SCHEMA)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The short overview: count, mean, std, min, quartiles, max at two decimals."""
    names = numeric_cols(df) if columns is None else columns
    shape, spread = _moments_and_quartiles(df, names)
    data = [
        (c, shape[c]["count"])
        + tuple(
            _rounded(v, 2)
            for v in (shape[c]["mean"], shape[c]["std"], shape[c]["min"], *spread[c], shape[c]["max"])
        )
        for c in names
    ]
    return rows(
        df.sparkSession,
        data,
        "column string, count long, mean double, std double, min double, "
        "q25 double, median double, q75 double, max double",
    )


def skew_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, skew, kurtosis), both corrected for bias, unrounded."""
    names = numeric_cols(df) if columns is None else columns
    found = moments(df, names)
    return rows(
        df.sparkSession,
        [(c, m["count"], m["skew"], m["kurtosis"]) for c, m in found.items()],
        "column string, n long, skew double, kurtosis double",
    )


def mad_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mad): mean absolute deviation from the mean."""
    names = numeric_cols(df) if columns is None else columns
    found = mean_absolute_deviation(df, {c: m["mean"] for c, m in moments(df, names).items()})
    return rows(df.sparkSession, list(found.items()), "column string, mad double")


def autocorrelation(
    df: DataFrame,
    column: str,
    order_by: list[str],
    lags: list[int] | None = None,
    partition_by: list[str] | None = None,
    **limits,
) -> DataFrame:
    """(keys..., lag, autocorrelation): correlation of the series with itself, shifted.

    Series with fewer than three values are left out.
    """
    require_numeric(df, column)
    lags = lags or [1, 2, 3]
    keys = partition_by or []
    needed = [*keys, *order_by]
    series = df.select(*[col(c) for c in dict.fromkeys(needed)], clean_number(column).alias("_y")).filter("_y IS NOT NULL")
    shifted = over_order(
        series,
        order_by,
        keys,
        max(lags),
        lambda w: {f"_lag{k}": F.lag("_y", k).over(w) for k in lags},
        **limits,
    )
    per_lag = [F.struct(F.lit(k).alias("lag"), pearson(F.col("_y"), F.col(f"_lag{k}")).alias("autocorrelation")) for k in lags]
    grouped = shifted.groupBy(*[col(k) for k in keys])
    return (
        grouped.agg(F.count("_y").alias("_n"), F.array(*per_lag).alias("_r"))
        .filter("_n >= 3")
        .select(*[col(k) for k in keys], F.inline("_r"))
    )
