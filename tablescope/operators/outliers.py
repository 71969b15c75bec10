"""Outliers per column and per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import clean_number, col, numeric_cols, rows, stack_rows
from tablescope.plans.quantiles import counted_quantiles


def robust_scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and robust standard deviation of the columns that can be judged."""
    counts, found = counted_quantiles(df, columns, [0.25, 0.5, 0.75])
    return {
        c: (median, (q3 - q1) * SETTINGS.iqr_to_sigma)
        for c, (q1, median, q3) in found.items()
        if counts[c] >= SETTINGS.min_rows_anomaly and q3 > q1
    }


def spikes_column(scales: dict[str, tuple[float, float]]) -> Column:
    """Array of (column, value, z) with the cells that lie too far from their median."""
    if not scales:
        return F.array().cast("array<struct<column:string,value:double,z:double>>")
    cells = []
    for name, (median, sigma) in scales.items():
        value = clean_number(name)
        z = F.abs(value - F.lit(median)) / F.lit(sigma)
        cells.append(
            F.when(
                z > SETTINGS.zscore_threshold,
                F.struct(F.lit(name).alias("column"), value.alias("value"), z.alias("z")),
            )
        )
    return F.array_compact(F.array(*cells))


def spikes_text(spikes: str = "spikes") -> Column:
    shown = F.transform(
        col(spikes),
        lambda s: F.concat(s["column"], F.lit("="), F.round(s["value"], 3).cast("string"), F.lit(" (z="), F.round(s["z"], 1).cast("string"), F.lit(")")),
    )
    return F.array_join(shown, ", ")


def robust_z_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table with ``spikes`` (the offending cells) and ``is_spike``; fitted scales enter as literals."""
    names = numeric_cols(df) if columns is None else columns
    flagged = df.withColumn("spikes", spikes_column(robust_scales(df, names)))
    return flagged.withColumn("is_spike", F.size("spikes") > 0)


_OUTLIER_SCHEMA = "column string, n long, outliers long, pct double, lower_bound double, upper_bound double"


def outlier_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column with at least four values: cells outside the quartile fences, most first."""
    names = numeric_cols(df) if columns is None else columns
    counts, quartiles = counted_quantiles(df, names, [0.25, 0.75])
    usable = [c for c in names if counts[c] >= 4]
    if not usable:
        return rows(df.sparkSession, [], _OUTLIER_SCHEMA)
    aggregates, entries = [], []
    for i, name in enumerate(usable):
        q1, q3 = quartiles[name]
        reach = SETTINGS.iqr_multiplier * (q3 - q1)
        value = clean_number(name)
        aggregates.append(F.count_if((value < F.lit(q1 - reach)) | (value > F.lit(q3 + reach))).alias(f"n{i}"))
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(counts[name]).cast("long").alias("n"),
                F.col(f"n{i}").alias("outliers"),
                F.round(100.0 * F.col(f"n{i}") / counts[name], 2).alias("pct"),
                F.lit(round(q1 - reach, 3)).alias("lower_bound"),
                F.lit(round(q3 + reach, 3)).alias("upper_bound"),
            )
        )
    return stack_rows(df.agg(*aggregates), entries).orderBy(F.col("outliers").desc(), "column")


def anomaly_rate(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """One row (anomalies, normal, rate_pct)."""
    flagged = F.count_if(col(flag))
    total = F.count(F.lit(1))
    return df.agg(
        flagged.alias("anomalies"),
        (total - flagged).alias("normal"),
        F.round(F.coalesce(F.try_divide(100.0 * flagged, total), F.lit(0.0)), 1).alias("rate_pct"),
    )
