"""Time series: trend, daily calendar, interpolation, decomposition, forecast."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import clean_number, col, require_columns, require_numeric
from tablescope.functions.smoothing import fit_many
from tablescope.plans.ordered import POSITION, largest_group, tie_break, with_positions
from tablescope.plans.shipping import ship_by_value
from tablescope.plans.storage import materialize

_WEEK = 7
#: Rows that a task sorts for a window, as far as series allow.
_ROWS_OF_A_SORT = 250_000


def _indexed(series: DataFrame, order_by: list[str], keys: list[str], hot_group_rows: int | None) -> DataFrame:
    """Add ``_i``, consecutive within each key; where it starts does not matter to a slope."""
    if largest_group(series, keys) <= (hot_group_rows or SETTINGS.hot_group_rows):
        # rows that are equal in `order_by` come in the order of the same hash as below
        spec = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c) for c in order_by], tie_break(series))
        return series.withColumn("_i", F.row_number().over(spec))
    return with_positions(series, [*keys, *order_by]).withColumnRenamed(POSITION, "_i")


def _trend_columns() -> dict[str, Column]:
    """Over aggregates ``_n``, ``_slope`` and ``_mean``."""
    slope = F.coalesce(F.col("_slope"), F.lit(0.0))
    enough = F.col("_n") >= 5
    share = F.coalesce(F.try_divide(slope * F.col("_n"), F.abs("_mean")) * 100, F.lit(0.0))
    direction = F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat")
    return {
        "trend": F.when(enough, direction).otherwise("insufficient_data"),
        "slope": F.when(enough, F.round(slope, 4)),
        "pct_change": F.when(enough, F.round(share, 2)),
    }


def trend_direction(
    df: DataFrame,
    value: str,
    order_by: list[str],
    partition_by: list[str] | None = None,
    hot_group_rows: int | None = None,
) -> DataFrame:
    """(keys..., points, trend, slope, pct_change): least-squares slope per step of the ordered series."""
    require_numeric(df, value)
    keys = partition_by or []
    wanted = dict.fromkeys([*keys, *order_by])
    series = df.select(*[col(c) for c in wanted], clean_number(value).alias("_y")).filter("_y IS NOT NULL")
    indexed = _indexed(series, order_by, keys, hot_group_rows)
    facts = indexed.groupBy(*[col(k) for k in keys]).agg(
        F.count("_y").alias("_n"), F.regr_slope("_y", "_i").alias("_slope"), F.avg("_y").alias("_mean")
    )
    shown = [c.alias(n) for n, c in _trend_columns().items()]
    return facts.select(*[col(k) for k in keys], F.col("_n").alias("points"), *shown)


def time_series_summary(
    df: DataFrame,
    date: str,
    value: str,
    tie_breakers: list[str] | None = None,
    partition_by: list[str] | None = None,
    hot_group_rows: int | None = None,
) -> DataFrame:
    """Trend per series with its first and last day, over all rows."""
    require_numeric(df, value)
    keys, order = partition_by or [], [date, *(tie_breakers or [])]
    wanted = dict.fromkeys([*keys, *order])
    series = (
        df.select(*[col(c) for c in wanted], clean_number(value).alias("_y"))
        .filter(F.col("_y").isNotNull() & col(date).isNotNull())
    )
    indexed = _indexed(series, order, keys, hot_group_rows)
    facts = indexed.groupBy(*[col(k) for k in keys]).agg(
        F.count("_y").alias("_n"),
        F.regr_slope("_y", "_i").alias("_slope"),
        F.avg("_y").alias("_mean"),
        F.to_date(F.min(col(date))).alias("start"),
        F.to_date(F.max(col(date))).alias("end"),
    )
    shown = [c.alias(n) for n, c in _trend_columns().items()]
    return facts.select(*[col(k) for k in keys], F.col("_n").alias("points"), *shown, "start", "end")


def _daily(df: DataFrame, date: str, value: str, keys: list[str]) -> DataFrame:
    """(keys..., day, value): mean per day, one row per day that has values."""
    require_columns(df, date, *keys)
    require_numeric(df, value)
    return (
        df.select(*[col(k) for k in keys], F.to_date(col(date)).alias("day"), clean_number(value).alias("value"))
        .filter("day IS NOT NULL AND value IS NOT NULL")
        .groupBy(*[col(k) for k in keys], "day")
        .agg(F.avg("value").alias("value"))
    )


def _by_day(keys: list[str]):
    # A series holds one row per calendar day, whatever the number of raw rows.
    return Window.partitionBy(*[col(k) for k in keys]).orderBy("day")


def calendar_runs(df: DataFrame, date: str, value: str, partition_by: list[str] | None = None) -> DataFrame:
    """(keys..., day, days, value, next_value): daily means as runs on a calendar without gaps.

    A run begins at a day with values and lasts ``days`` days, up to the next such day; a gap of any length is one row.
    ``next_value`` is the mean on the day behind the run, NULL behind the last one, which lasts one day.
    """
    keys = partition_by or []
    order = _by_day(keys)
    known = _daily(df, date, value, keys)
    lasts = F.coalesce(F.datediff(F.lead("day").over(order), "day"), F.lit(1))
    return known.select(
        *[col(k) for k in keys], "day", lasts.alias("days"), "value", F.lead("value").over(order).alias("next_value")
    )


def _exploded(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., day, past, days, value, next_value): every day of every run, ``past`` days after its first."""
    each = runs.withColumn("past", F.explode(F.sequence(F.lit(0), F.col("days") - 1)))
    return each.select(*[col(k) for k in keys], F.date_add("day", F.col("past")).alias("day"), "past", "days", "value", "next_value")


def _on_line(days: DataFrame, keys: list[str]) -> DataFrame:
    step = (F.col("next_value") - F.col("value")) * F.col("past") / F.col("days")
    filled = F.when(F.col("past") == 0, F.col("value")).otherwise(F.col("value") + step)
    return days.select(*[col(k) for k in keys], "day", filled.alias("value"))


def resample_daily(df: DataFrame, date: str, value: str, partition_by: list[str] | None = None) -> DataFrame:
    """(keys..., day, value): daily means on a calendar without gaps; value is NULL on added days.

    Each known day generates the missing days up to the next one, so the
    calendar needs no join.  ``calendar_runs`` is the same without a row per day.
    """
    keys = partition_by or []
    days = _exploded(calendar_runs(df, date, value, keys), keys)
    return days.select(*[col(k) for k in keys], "day", F.when(F.col("past") == 0, F.col("value")).alias("value"))


def daily_series(df: DataFrame, date: str, value: str, partition_by: list[str] | None = None) -> DataFrame:
    """Gap-free daily means with gaps filled by straight lines between known days."""
    keys = partition_by or []
    return _on_line(_exploded(calendar_runs(df, date, value, keys), keys), keys)


def interpolate_linear(
    df: DataFrame,
    order: str,
    value: str,
    partition_by: list[str] | None = None,
    hot_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Fill NULLs on the line between their known neighbours, by position in the order.

    Values after the last known one repeat it; values before the first stay
    NULL.  Series beyond the size bound are cut into blocks that hand the known
    values at their edges on to each other.
    """
    keys = partition_by or []
    sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    if (size["largest"] or 0) <= (hot_group_rows or SETTINGS.hot_group_rows):
        if keys:  # rows may come of few (gaps that were filled up), so their own number says how many tasks sort them
            tasks = max(df.sparkSession.sparkContext.defaultParallelism, (size["total"] or 0) // _ROWS_OF_A_SORT + 1)
            df = df.repartition(tasks, *[col(k) for k in keys])
        place = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(order), tie_break(df))
        around = _known_neighbours(df.withColumn("_i", F.row_number().over(place)), keys, value)
    else:
        block = F.floor(F.col("_i") / (block_rows or SETTINGS.split_block_rows))
        placed = with_positions(df, [*keys, order]).withColumnRenamed(POSITION, "_i").withColumn("_block", block)
        around = _neighbours_across_blocks(_known_neighbours(placed, [*keys, "_block"], value), keys)
    a, b = F.col("_a"), F.col("_b")
    step = (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
    filled = F.coalesce(col(value), a["v"] + step, a["v"])
    return around.withColumn(value, filled).select(*[col(c) for c in df.columns])


def _known_neighbours(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``_known`` and the nearest known (position, value) at or before, and at or after each row."""
    group = [col(k) for k in keys]
    # Both frames start at an end of the group, so each is one running pass.
    past = Window.partitionBy(*group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*group).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(col(value).isNotNull(), F.struct(F.col("_i").alias("i"), col(value).alias("v")))
    return df.withColumn("_known", known).withColumns(
        {"_a": F.last("_known", ignorenulls=True).over(past), "_b": F.last("_known", ignorenulls=True).over(future)}
    )


def _neighbours_across_blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Complete the neighbours of each block from the blocks before and after it."""
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.withColumns({n: col(k) for n, k in zip(names, keys)})
    edges = keyed.groupBy(*names, "_block").agg(F.min("_known").alias("_first"), F.max("_known").alias("_last"))
    whole = Window.partitionBy(*names)  # one row per block of a series
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    handed = edges.select(
        *[F.col(n).alias(f"{n}_") for n in names],
        F.col("_block").alias("_block_"),
        F.last("_last", ignorenulls=True).over(before).alias("_a_"),
        F.last("_first", ignorenulls=True).over(after).alias("_b_"),
    )
    same = F.col("_block") == F.col("_block_")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return keyed.join(handed, same).withColumns(
        {"_a": F.coalesce("_a", "_a_"), "_b": F.coalesce("_b", "_b_")}
    )


def actuals_by_date(df: DataFrame, date: str, value: str) -> DataFrame:
    """(date, value): mean of the rows that share a date value."""
    return (
        df.select(col(date).alias("date"), clean_number(value).alias("value"))
        .dropna()
        .groupBy("date")
        .agg(F.avg("value").alias("value"))
    )


def seasonal_decompose(
    df: DataFrame, date: str, value: str, period: int = _WEEK, partition_by: list[str] | None = None
) -> DataFrame:
    """(keys..., day, value, trend, seasonal, resid): additive parts of each daily series.

    Series shorter than two periods are left out.  The trend is a centred
    moving average whose ends continue on the straight line through the
    nearest ``period`` trend values.
    """
    keys = [col(k) for k in partition_by or []]
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("day")
    half = period // 2
    base = (
        daily_series(df, date, value, partition_by)
        .withColumn("_i", F.row_number().over(ordered) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .filter(F.col("_n") >= 2 * period)
    )
    around = ordered.rowsBetween(-half, half)
    if period % 2:
        mean = F.avg("value").over(around)
    else:
        ends = F.lag("value", half).over(ordered) + F.lead("value", half).over(ordered)
        mean = (F.sum("value").over(around) - ends / 2) / period
    first, last = F.lit(half), F.col("_n") - 1 - half
    i = F.col("_i")
    smooth = base.withColumn("_t", F.when((i >= first) & (i <= last), mean))
    # The line at the start uses the first `period` trend values, the one at the end the `period` before the last.
    head = (i >= first) & (i < F.least(first + period, last))
    tail = (i >= F.greatest(first, last - period)) & (i < last)
    lines = smooth.withColumns(
        {
            f"_{part}_{end}": fit(F.when(rows_, F.col("_t")), i).over(whole)
            for end, rows_ in (("head", head), ("tail", tail))
            for part, fit in (("slope", F.regr_slope), ("base", F.regr_intercept))
        }
    )
    trend = (
        F.when(i < first, F.col("_base_head") + F.col("_slope_head") * i)
        .when(i > last, F.col("_base_tail") + F.col("_slope_tail") * i)
        .otherwise(F.col("_t"))
    )
    phase = Window.partitionBy(*keys, F.col("_i") % period)
    parts = (
        lines.withColumn("trend", trend)
        .withColumn("_phase", F.avg(F.col("value") - F.col("trend")).over(phase))
        .withColumn("seasonal", F.col("_phase") - F.avg(F.when(F.col("_i") < period, F.col("_phase"))).over(whole))
    )
    return parts.select(
        *keys, "day", "value", "trend", "seasonal",
        (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"),
    )


def holt_winters_forecast(
    df: DataFrame,
    date: str,
    value: str,
    horizon: int = 30,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """(keys..., ds, yhat, yhat_lower, yhat_upper, is_forecast) per series.

    Series with fewer than 14 raw points are left out.  History rows carry the
    daily value in all three columns.  A series is one row in one task, whose
    size is its number of days with values: a gap is one run, and the fit walks
    a long straight line in closed form; a task fits many series side by side.  Forecast rows need no history rows; days
    beyond the calendar's end (9999-12-31) are left out.
    """
    ship_by_value()
    keys = partition_by or []
    require_columns(df, date, *keys)
    raw = df.select(*[col(k) for k in keys], col(date), clean_number(value).alias(value)).dropna(subset=[date, value])
    enough = raw.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_points"))
    enough = enough.filter(F.col("_points") >= SETTINGS.min_rows_forecast)
    runs = calendar_runs(raw, date, value, keys)
    if keys:
        runs = runs.join(enough.drop("_points"), keys, "left_semi")
    elif not enough.take(1):
        runs = runs.limit(0)
    shown = [col(k) for k in keys]
    run = F.struct("day", "days", "value", "next_value")
    series = runs.groupBy(*shown).agg(F.sort_array(F.collect_list(run)).alias("_runs")).filter(F.size("_runs") > 0)
    if keys:  # fitting takes far longer than its few bytes suggest, hence the given number of tasks
        series = series.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("yhat array<double>, spread double")
    def fit(value: pd.Series, days: pd.Series, next_value: pd.Series) -> pd.DataFrame:
        lines = []
        for first, length, after in zip(value, days, next_value):
            first, length = np.asarray(first, dtype=float), np.asarray(length)
            lines.append((first, length, np.nan_to_num(np.asarray(after, dtype=float) - first) / length))
        found = fit_many(lines, horizon)
        return pd.DataFrame({"yhat": [ahead for ahead, _ in found], "spread": [spread for _, spread in found]})

    fitted = fit("_runs.value", "_runs.days", "_runs.next_value").alias("_fit")
    # stored, as a sort of the forecasts would fit the series twice
    fits = materialize(series.select(*shown, F.element_at("_runs", -1)["day"].alias("_last"), fitted))
    ahead = fits.select(*shown, "_last", F.col("_fit.spread").alias("_spread"), F.posexplode("_fit.yhat").alias("_step", "yhat"))
    ahead = ahead.filter(F.datediff(F.lit(datetime.date.max), "_last") > F.col("_step")).select(
        *shown, F.date_add("_last", F.col("_step") + 1).alias("ds"), "yhat",
        (F.col("yhat") - 1.96 * F.col("_spread")).alias("yhat_lower"), (F.col("yhat") + 1.96 * F.col("_spread")).alias("yhat_upper"),
    )
    past = _on_line(_exploded(runs, keys), keys)
    history = past.select(*shown, F.col("day").alias("ds"), *[F.col("value").alias(n) for n in ("yhat", "yhat_lower", "yhat_upper")])
    return history.withColumn("is_forecast", F.lit(False)).unionByName(ahead.withColumn("is_forecast", F.lit(True)))


def forecast_after(forecast: DataFrame, last_actual) -> DataFrame:
    """Forecast rows later than the given date."""
    return forecast.filter(F.col("ds") > F.lit(last_actual))
