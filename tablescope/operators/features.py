"""Derived columns: calendar parts, lags, trailing means, category frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tablescope.functions.columns import categorical_cols, clean_number, col, datetime_cols, numeric_cols
from tablescope.plans.frequency import few_valued
from tablescope.plans.ordered import over_order

_ROLLING_ROWS = 3
_MAX_FREQ_LEVELS = 20


def _dated(df: DataFrame, columns: list[str]) -> list[str]:
    """Date columns with at least one value."""
    if not columns:
        return []
    counts = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if counts[f"n{i}"]]


def _calendar_columns(names: list[str]) -> dict[str, Column]:
    parts: dict[str, Column] = {}
    for name in names:
        parts[f"{name}_year"] = F.year(col(name))
        parts[f"{name}_month"] = F.month(col(name))
        parts[f"{name}_day_of_week"] = F.weekday(col(name))
        parts["day_of_week"] = F.weekday(col(name))
    return parts


def calendar_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Year, month and weekday (Monday is 0) of each date column; ``day_of_week`` follows the last one."""
    return df.withColumns(_calendar_columns(_dated(df, datetime_cols(df) if columns is None else columns)))


def _shifted(names: list[str], max_lags: int):
    def build(spec: WindowSpec) -> dict[str, Column]:
        made = {}
        trailing = spec.rowsBetween(-(_ROLLING_ROWS - 1), 0)
        for name in names:
            for k in range(1, max_lags + 1):
                made[f"{name}_lag_{k}"] = F.lag(col(name), k).over(spec)
            made[f"{name}_rolling_mean_{_ROLLING_ROWS}"] = F.avg(clean_number(name)).over(trailing)
        return made

    return build


def lag_features(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    partition_by: list[str] | None = None,
    max_lags: int = 2,
    **limits,
) -> DataFrame:
    """Earlier values and the mean of the last three rows, in an explicit order per key."""
    return over_order(
        df, order_by, partition_by or [], max(max_lags, _ROLLING_ROWS - 1), _shifted(columns, max_lags), **limits
    )


def frequency_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``{c}_freq``: how many rows share the value, for text columns with at most 20 distinct values.

    The few counts become literals, so the rows are not shuffled by a column
    with hot values.
    """
    names = categorical_cols(df) if columns is None else columns
    made = {}
    for name, levels in few_valued(df, names, _MAX_FREQ_LEVELS).items():
        known = [F.lit(x) for pair in levels.items() if pair[0] is not None for x in pair]
        by_value = F.create_map(*known)[col(name)]
        missing = F.lit(levels.get(None)).cast("long")
        made[f"{name}_freq"] = F.when(col(name).isNull(), missing).otherwise(by_value).cast("long")
    return df.withColumns(made)


def engineer_features(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] | None = None,
    date_columns: list[str] | None = None,
    value_columns: list[str] | None = None,
    max_lags: int = 2,
    calendar_lags: bool = False,
) -> tuple[DataFrame, list[str]]:
    """All features and the names of the new columns.

    Numeric columns are those of the input; ``calendar_lags`` also shifts the
    calendar columns just made.
    """
    values = numeric_cols(df) if value_columns is None else list(value_columns)
    dated = calendar_features(df, date_columns)
    if calendar_lags:
        values += [c for c in dated.columns if c not in df.columns]
    counted = frequency_features(dated, categorical_cols(df))
    made = lag_features(counted, values, order_by, partition_by, max_lags)
    return made, [c for c in made.columns if c not in df.columns]
