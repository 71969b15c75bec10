"""The data behind each chart as a DataFrame; drawing is left to the reader's tool.

All rows are used.  Charts of single points take an argument ``n`` that draws
that many rows instead (``sample_rows``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.config import SETTINGS
from tablescope.errors import ValidationError
from tablescope.functions.columns import (
    categorical_cols,
    clean_number,
    col,
    datetime_cols,
    exact_number,
    numeric_cols,
    pearson,
    present,
    require_columns,
    require_numeric,
    rows,
)
from tablescope.functions.normal import normal_quantile
from tablescope.operators.describe import corrected_skew
from tablescope.operators.ingest import sample_rows
from tablescope.operators.relate import correlation_matrix, strength_of
from tablescope.plans.frequency import cumulative_counts, few_valued, group_quantiles
from tablescope.plans.ordered import over_order
from tablescope.plans.shipping import ship_by_value
from tablescope.plans.storage import materialize

_GRID = 200
_CHUNK = 10_000


# --- distributions -----------------------------------------------------------


def _range_of(df: DataFrame, *names: str) -> list[tuple[float, float]]:
    aggregates = []
    for i, name in enumerate(names):
        aggregates += [F.min(clean_number(name)).alias(f"a{i}"), F.max(clean_number(name)).alias(f"b{i}")]
    row = df.agg(*aggregates).first()
    return [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(names))]


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin; the last one includes its upper end."""
    width = (high - low) / bins
    if width == 0:
        return F.when(value.isNotNull(), F.lit(0).cast("long"))
    return F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("long"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, low, high, n): those of ``bins`` equal-width bins that hold rows."""
    require_numeric(df, column)
    if bins < 1:
        raise ValidationError("A histogram has one bin or more")
    ((low, high),) = _range_of(df, column)
    if low is None:
        return rows(df.sparkSession, [], "bin long, low double, high double, n long")
    width = (high - low) / bins
    return (
        df.select(_bin(clean_number(column), low, high, bins).alias("bin"))
        .filter("bin IS NOT NULL")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
            "n",
        )
    )


#: Powers of the distance from a bin's centre that are summed, and bins to a bandwidth.
_MOMENTS, _BINS_PER_BANDWIDTH = 10, 4
#: Bandwidths beyond which a kernel's share is below 1e-15.
_REACH = 8.4
#: Groups whose figures are sent to every task; beyond, they are joined to rows that were added up before.
_LOOKUP_GROUPS = 200_000


def _hermite() -> list[list[int]]:
    """Coefficients of the polynomials He_0 to He_(_MOMENTS - 1), lowest power first."""
    table = [[1], [0, 1]]
    for k in range(1, _MOMENTS - 1):
        shifted = [0, *table[k]]
        table.append([c - k * (table[k - 1][j] if j < len(table[k - 1]) else 0) for j, c in enumerate(shifted)])
    return table


def _binned(known: DataFrame, keys: list[str], origin: Column, width: Column) -> DataFrame:
    """(keys, centre, m0, m1, ...): sums of powers of the distances from the bins' centres, in widths."""
    place = (F.col("v") - origin) / width
    tagged = known.withColumns({"bin": F.floor(place), "width": width, "origin": origin})
    distance = (F.col("v") - F.col("origin")) / F.col("width") - (F.col("bin") + 0.5)
    tagged = tagged.withColumn("t", distance)
    power, sums = F.lit(1.0), []
    for k in range(_MOMENTS):
        sums.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("t")
    found = tagged.groupBy(*keys, "bin", "width", "origin").agg(*sums)
    return found.withColumn("centre", F.col("origin") + (F.col("bin") + 0.5) * F.col("width")).drop("bin", "origin")


def _densities(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys..., point, at, density) on 200 points from the group's minimum to its maximum.

    Rows are added up in bins of at most a quarter of the bandwidth h, with ten powers of their distances from the bin's
    centre. A kernel around a row is the kernel around the centre times a series in these powers (Hermite polynomials),
    so each bin gives its share to the points within reach in one go. The series is cut after the tenth term; with
    distances of at most h / 8 the error of a density is below 1e-12 / h.
    """
    slots = [f"k{i}" for i in range(len(keys))]
    known = df.select(*[col(k).alias(s) for k, s in zip(keys, slots)], clean_number(value).alias("v")).dropna()
    scale = (
        known.groupBy(*slots)
        .agg(F.count("v").alias("total"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))
        .filter("total >= 3 AND sd > 0")
        .withColumn("h", F.col("sd") * F.pow("total", F.lit(-0.2)))
    )
    fields = ("total", "low", "high", "h")
    if not keys:
        one = scale.first()
        if one is None:
            return rows(df.sparkSession, [], "point int, at double, density double")
        binned = _binned(known, [], F.lit(one["low"]), F.lit(one["h"] / _BINS_PER_BANDWIDTH))
        binned = binned.withColumns({c: F.lit(one[c]) for c in fields})
    else:
        scale = materialize(scale.select(*slots, *fields))
        size = scale.agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).first()
        if size["n"] <= _LOOKUP_GROUPS:
            looked_up = known.join(F.broadcast(scale), slots)
            binned = _binned(looked_up, [*slots, *fields], F.col("low"), F.col("h") / _BINS_PER_BANDWIDTH)
        else:  # bins that are narrow enough for all groups, before rows meet their group's figures
            binned = _binned(known, slots, F.lit(0.0), F.lit(size["h"] / _BINS_PER_BANDWIDTH)).join(scale, slots)
    # the bin's share of the density at z bandwidths from its centre is K(z) times a polynomial in z
    hermite = _hermite()
    scaled = [F.col(f"m{k}") * F.pow(F.col("width") / F.col("h"), F.lit(float(k))) / float(math.factorial(k)) for k in range(_MOMENTS)]
    polynomial = {
        f"b{j}": sum((scaled[k] * float(hermite[k][j]) for k in range(j + 1, _MOMENTS) if j < len(hermite[k]) and hermite[k][j]), scaled[j] * float(hermite[j][j]))
        for j in range(_MOMENTS)
    }
    step = (F.col("high") - F.col("low")) / (_GRID - 1)
    first = F.greatest(F.lit(0.0), F.ceil((F.col("centre") - _REACH * F.col("h") - F.col("low")) / step).cast("double"))
    last = F.least(F.lit(_GRID - 1.0), F.floor((F.col("centre") + _REACH * F.col("h") - F.col("low")) / step).cast("double"))
    reached = binned.withColumns({**polynomial, "first": first.cast("int"), "last": last.cast("int")}).where("first <= last")
    points = reached.select(*slots, *fields, "centre", *polynomial, F.explode(F.sequence("first", "last")).alias("point"))
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (_GRID - 1)
    points = points.withColumn("z", (at - F.col("centre")) / F.col("h"))
    series = F.col(f"b{_MOMENTS - 1}")
    for j in range(_MOMENTS - 2, -1, -1):
        series = series * F.col("z") + F.col(f"b{j}")
    shares = points.withColumn("share", F.exp(-F.col("z") * F.col("z") / 2) * series)
    grid = F.array(*[F.lit(i) for i in range(_GRID)])
    summed = shares.groupBy(*slots, *fields, "point").agg(F.sum("share").alias("s"))
    # points that no bin reaches have density 0
    every = (scale if keys else _one_row(df, one, fields)).select(*slots, *fields, F.explode(grid).alias("point"))
    norm = F.col("total") * F.col("h") * math.sqrt(2 * math.pi)
    held = summed.select(*slots, *fields, "point", (F.col("s") / norm).alias("density"))
    both = held.unionByName(every.withColumn("density", F.lit(0.0))).groupBy(*slots, *fields, "point")
    density = F.greatest(F.lit(0.0), F.sum("density"))  # rounding far out
    return both.agg(density.alias("density")).select(
        *[F.col(s).alias(k) for k, s in zip(keys, slots)], "point", at.alias("at"), "density"
    )


def _one_row(df: DataFrame, row, fields: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.range(1).select(*[F.lit(row[c]).alias(c) for c in fields])


def kde(df: DataFrame, column: str) -> DataFrame:
    """(point, x, density): Gaussian kernel, Scott bandwidth; empty below three values."""
    require_numeric(df, column)
    return _densities(df, column, []).withColumnRenamed("at", "x")


def _group_freq(df: DataFrame, x: str | None, y: str) -> DataFrame:
    """Rows per (x, y), stored once: cut points, range totals, running counts and fences all read it."""
    keys = [col(x).alias("x")] if x else []
    return materialize(
        df.filter(col(y).isNotNull())  # reaches the file scan
        .select(*keys, exact_number(df, y).alias("y"))
        .dropna()
        .groupBy(*(["x"] if x else []), "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _with_group_figures(freq: DataFrame, figures: DataFrame) -> DataFrame:
    """Rows with their group's figures: looked up in each task, unless there are too many groups for that."""
    stored = materialize(figures)
    return freq.join(F.broadcast(stored) if stored.count() <= _LOOKUP_GROUPS else stored, "x")


def box_stats(df: DataFrame, x: str | None, y: str) -> DataFrame:
    """(x, n, q1, median, q3, whisker_low, whisker_high, notch_low, notch_high, outliers) per group.

    Without ``x`` one row, without that column, for the whole column ``y``.
    """
    require_numeric(df, y)
    if x is not None:
        require_columns(df, x)
    freq = _group_freq(df, x, y)
    if x is None:
        freq = freq.withColumn("x", F.lit(0))
    boxes = group_quantiles(freq, ["x"], "y", [0.25, 0.5, 0.75]).selectExpr(
        "x", "total AS n_rows", "q0 AS q1", "q1 AS median", "q2 AS q3"
    )
    reach = SETTINGS.iqr_multiplier * (F.col("q3") - F.col("q1"))
    inside = (F.col("y") >= F.col("q1") - reach) & (F.col("y") <= F.col("q3") + reach)
    half_notch = 1.57 * (F.col("q3") - F.col("q1")) / F.sqrt("n_rows")
    found = (
        _with_group_figures(freq, boxes)
        .groupBy("x", "n_rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("y"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("long").alias("outliers"),
        )
        .select(
            "x",
            F.col("n_rows").alias("n"),
            "q1",
            "median",
            "q3",
            "whisker_low",
            "whisker_high",
            (F.col("median") - half_notch).alias("notch_low"),
            (F.col("median") + half_notch).alias("notch_high"),
            "outliers",
        )
    )
    return found if x is not None else found.drop("x")


def violin(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, point, value, density, q1, median, q3): one density curve and box per group."""
    require_numeric(df, y)
    named = df.select(col(x).alias("x"), col(y).alias("y"))
    curves = _densities(named, "y", ["x"]).withColumnRenamed("at", "value")
    boxes = group_quantiles(_group_freq(df, x, y), ["x"], "y", [0.25, 0.5, 0.75])
    return curves.join(boxes.selectExpr("x", "q0 AS q1", "q1 AS median", "q2 AS q3"), "x")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, share): share of rows up to each distinct value."""
    require_numeric(df, column)
    placed = cumulative_counts(_group_freq(df, None, column), [], "y")
    return placed.select(F.col("y").alias("value"), ((F.col("before") + F.col("n")) / F.col("total")).alias("share"))


def qq(df: DataFrame, column: str) -> DataFrame:
    """(position, probability, theoretical, value): ordered values against Filliben's normal medians.

    Runs of equal values are cut into chunks and spread again before they are
    expanded, so a value held by many rows does not end up in one task.
    """
    require_numeric(df, column)
    placed = cumulative_counts(_group_freq(df, None, column), [], "y")
    chunks = placed.select(
        F.col("y").alias("value"),
        "total",
        (F.col("before") + F.col("n")).alias("end"),
        F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"), F.lit(_CHUNK))).alias("start"),
    ).repartition("value", "start")
    points = chunks.select(
        "value",
        "total",
        F.explode(F.sequence("start", F.least(F.col("start") + (_CHUNK - 1), F.col("end")))).alias("position"),
    )
    n, i = F.col("total"), F.col("position")
    edge = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(i == n, edge).when(i == 1, 1.0 - edge).otherwise((i - 0.3175) / (n + 0.365))
    return points.filter("total >= 5").select(
        "position", p.alias("probability"), normal_quantile(p).alias("theoretical"), "value"
    )


def qq_line(df: DataFrame, column: str) -> DataFrame:
    """(slope, intercept, n) of the straight line through the Q-Q points."""
    return qq(df, column).agg(
        F.regr_slope("value", "theoretical").alias("slope"),
        F.regr_intercept("value", "theoretical").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


# --- relationships -------------------------------------------------------------


def _points(df: DataFrame, needed: list[str], optional: str | None = None) -> DataFrame:
    names = list(dict.fromkeys([*needed, *([optional] if optional else [])]))
    return df.select(*[col(c) for c in names]).dropna(subset=[n for n in needed])


def _drawn(points: DataFrame, n: int | None) -> DataFrame:
    """All points, or ``n`` of them."""
    return points if n is None else sample_rows(points, n)


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, n: int | None = None) -> DataFrame:
    """One point per row; ``trend_lines`` gives the line through them."""
    return _drawn(_points(df, [x, y], color), n)


def trend_lines(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """(color, n, slope, intercept): least-squares line of y on x over all rows, per colour."""
    a, b = clean_number(x), clean_number(y)
    keys = [col(color).alias("color")] if color else []
    return (
        df.select(*keys, a.alias("a"), b.alias("b"))
        .dropna(subset=["a", "b"])
        .groupBy(*(["color"] if color else []))
        .agg(
            F.count("a").alias("n"),
            F.regr_slope("b", "a").alias("slope"),
            F.regr_intercept("b", "a").alias("intercept"),
        )
    )


def bubble(df: DataFrame, x: str, y: str, size: str, color: str | None = None, n: int | None = None) -> DataFrame:
    return _drawn(_points(df, [x, y, size], color), n)


def density_2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """(x_bin, y_bin, n): counts on a grid of equal-width cells."""
    require_numeric(df, x)
    require_numeric(df, y)
    pairs = df.select(clean_number(x).alias("x"), clean_number(y).alias("y")).dropna()
    (x0, x1), (y0, y1) = _range_of(pairs, "x", "y")
    if x0 is None:
        return rows(df.sparkSession, [], "x_bin long, y_bin long, n long")
    return (
        pairs.select(_bin(F.col("x"), x0, x1, bins).alias("x_bin"), _bin(F.col("y"), y0, y1, bins).alias("y_bin"))
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pair_points(df: DataFrame, columns: list[str], color: str | None = None, n: int | None = None) -> DataFrame:
    """Points of a scatter matrix."""
    return _drawn(_points(df, columns, color), n)


def pair_matrix(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """(a, b, a_bin, b_bin, n): the 2-d density of every pair of columns, in one scan."""
    names = columns
    for name in names:
        require_numeric(df, name)
    spans = dict(zip(names, _range_of(df, *names)))
    panels = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            _bin(clean_number(a), *spans[a], bins).alias("a_bin"),
            _bin(clean_number(b), *spans[b], bins).alias("b_bin"),
        )
        for a, b in combinations([c for c in names if spans[c][0] is not None], 2)
    ]
    if not panels:
        return rows(df.sparkSession, [], "a string, b string, a_bin long, b_bin long, n long")
    return (
        df.select(F.inline(F.array(*panels)))
        .filter("a_bin IS NOT NULL AND b_bin IS NOT NULL")
        .groupBy("a", "b", "a_bin", "b_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return correlation_matrix(df, "pearson", columns, digits=2)


def parallel_coordinates(
    df: DataFrame, columns: list[str], color: str | None = None, n: int | None = None
) -> DataFrame:
    return _drawn(_points(df, columns, color), n)


def radar(df: DataFrame, category: str, values: list[str], top: int | None = None) -> DataFrame:
    """Means per category, in the categories' own order; ``top`` keeps the first ones only."""
    means = (
        df.filter(col(category).isNotNull())
        .groupBy(col(category).alias("category"))
        .agg(*[F.avg(clean_number(v)).alias(v) for v in values])
        .orderBy("category")
    )
    return means if top is None else means.limit(top)


# --- categories ------------------------------------------------------------------

_AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp,
    "var": F.var_samp, "nunique": F.count_distinct,
}


def bar(df: DataFrame, x: str, y: str, agg: str = "mean", top: int = 30) -> DataFrame:
    """(x, value): the aggregate per category, the 30 largest; ``median`` is exact."""
    if agg not in (*_AGGREGATES, "median"):
        raise ValidationError(f"Unknown aggregate {agg!r}: one of {', '.join([*_AGGREGATES, 'median'])}")
    require_columns(df, x, y)
    groups = df.filter(col(x).isNotNull()).groupBy(col(x).alias("x"))
    if agg == "median":
        # a category without numbers stays, with no value
        medians = group_quantiles(_group_freq(df, x, y), ["x"], "y", [0.5]).select("x", F.col("q0").cast("double").alias("value"))
        found = groups.agg(F.lit(None).cast("double").alias("value")).unionByName(medians).groupBy("x").agg(F.max("value").alias("value"))
    else:
        found = groups.agg(_AGGREGATES[agg](clean_number(y)).alias("value"))
    return found.orderBy(F.col("value").desc_nulls_last(), "x").limit(top)


def _by_group(df: DataFrame, x: str, y: str, group: str, agg) -> DataFrame:
    return (
        df.filter(col(x).isNotNull() & col(group).isNotNull())
        .groupBy(col(x).alias("x"), col(group).alias("group"))
        .agg(agg(clean_number(y)).alias("value"))
    )


def grouped_bar(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(x, group, value): means."""
    return _by_group(df, x, y, group, F.avg)


def stacked_bar(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(x, group, value): sums."""
    return _by_group(df, x, y, group, F.sum)


def count_plot(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """(value, n): the most frequent values."""
    return (
        df.filter(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "value")
        .limit(top)
    )


def pie(df: DataFrame, names: str, values: str | None = None) -> DataFrame:
    """(name, value, share): sums of ``values`` or row counts, also the data of a donut."""
    amount = F.sum(clean_number(values)) if values else F.count(F.lit(1))
    parts = materialize(df.filter(col(names).isNotNull()).groupBy(col(names).alias("name")).agg(amount.alias("value")))
    total = parts.agg(F.sum("value").alias("_total")).first()["_total"]
    return parts.withColumn("share", F.try_divide(F.col("value"), F.lit(total)))


def hierarchy(df: DataFrame, path: list[str], values: str) -> DataFrame:
    """(level, path columns, value): sums at every level, the data of a treemap or sunburst.

    Level 0 is the whole table; deeper columns are NULL above their level.
    """
    depth = len(path)
    known = df.select(*[col(p) for p in path], clean_number(values).alias("_v")).dropna(subset=path)
    level = F.lit(depth) - F.bit_count(F.grouping_id())
    return (
        known.rollup(*[col(p) for p in path])
        .agg(F.sum("_v").alias("value"), level.cast("int").alias("level"))
        .select("level", *[col(p) for p in path], "value")
    )


# --- time ---------------------------------------------------------------------------


def line(df: DataFrame, x: str, y: str, color: str | None = None, n: int | None = None) -> DataFrame:
    """Points in x order."""
    needed = [x, y, *([color] if color else [])]
    return _drawn(_points(df, needed), n).orderBy(col(x))


def line_means(df: DataFrame, x: str, y: str, unit: str = "day", color: str | None = None) -> DataFrame:
    """(bucket, color, value, n): mean per time unit over all rows, the line for large tables."""
    keys = ["bucket", *(["color"] if color else [])]
    shade = [col(color).alias("color")] if color else []
    return (
        df.select(F.date_trunc(unit, col(x)).cast(df.schema[x].dataType).alias("bucket"), *shade, clean_number(y).alias("y"))
        .dropna()
        .groupBy(*keys)
        .agg(F.avg("y").alias("value"), F.count("y").alias("n"))
    )


def area(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """All points in x order."""
    needed = [x, y, *([color] if color else [])]
    return _points(df, needed).orderBy(col(x))


def rolling_average(
    df: DataFrame,
    x: str,
    y: str,
    window: int = 7,
    tie_breakers: list[str] | None = None,
    partition_by: list[str] | None = None,
    **limits,
) -> DataFrame:
    """The points with ``rolling``, the mean of the last ``window`` rows in x order."""
    keys, ties = partition_by or [], tie_breakers or []
    wanted = list(dict.fromkeys([*keys, x, *ties, y]))
    points = df.select(*[col(c) for c in wanted]).dropna(subset=[x, y])
    return over_order(
        points,
        [x, *ties],
        keys,
        window - 1,
        lambda spec: {"rolling": F.avg(clean_number(y)).over(spec.rowsBetween(-(window - 1), 0))},
        **limits,
    )


# --- missing values ------------------------------------------------------------------


def missing_map(df: DataFrame, order_by: str, buckets: int = 50) -> DataFrame:
    """(bucket, column, n_rows, n_missing) along equal-width ranges of a numeric or time column."""
    require_columns(df, order_by)
    if order_by in datetime_cols(df):
        place = F.unix_micros(col(order_by).cast("timestamp")).cast("double")
    else:
        require_numeric(df, order_by)
        place = clean_number(order_by)
    span = df.agg(F.min(place).alias("a"), F.max(place).alias("b")).first()
    names = [c for c in df.columns if c != order_by]
    if span["a"] is None:
        return rows(df.sparkSession, [], "bucket long, column string, n_rows long, n_missing long")
    counted = (
        df.withColumn("_bucket", _bin(place, span["a"], span["b"], buckets))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(names)]
    return counted.select(F.col("_bucket").alias("bucket"), "n_rows", F.inline(F.array(*entries))).select(
        "bucket", "column", "n_rows", "n_missing"
    )


# --- choice and reading of charts -----------------------------------------------------

_PLAN_SCHEMA = "ord int, title string, kind string, x string, y string, color string"
_MAX_CHART_LEVELS = 30
_MANY = 10**9

# One line per chart: kind, the numbers, groups and dates it takes (``narrow`` is the group of fewest levels), title.
# A chart is drawn when the table has all that its slots name; ``*`` in front of a slot marks one that may be absent.
_CHART_RULES = [
    ("bar", "narrow", "number1", "", "{y} by {x}"),
    ("count", "narrow", "", "", "Rows per {x}"),
    ("line", "date1", "number1", "", "{y} along {x}"),
    ("scatter", "number1", "number2", "*group1", "{x} against {y}"),
    ("histogram", "number1", "", "", "Values of {x}"),
    ("heatmap", "number3", "", "", "Correlations"),
    ("box", "group1", "number2", "", "{y} by {x}"),
    ("missing", "holes", "", "", "Missing values"),
]
_WHOLE_TABLE = {"heatmap", "missing"}


def _slots(df: DataFrame) -> dict[str, str]:
    """Names that the rules refer to, for those that the table has."""
    levels = few_valued(df, categorical_cols(df), _MAX_CHART_LEVELS)
    sizes = {c: len(levels[c].keys() - {None}) for c in categorical_cols(df) if c in levels}
    groups = [c for c, n in sizes.items() if n >= 2]
    lists = {"number": numeric_cols(df), "group": groups, "date": datetime_cols(df)}
    found = {f"{kind}{i}": c for kind, names in lists.items() for i, c in enumerate(names, 1)}
    if groups:
        found["narrow"] = min(groups, key=lambda c: sizes.get(c, _MANY))
    empty = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    if any(empty):
        found["holes"] = "table"
    return found


def auto_charts(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The charts worth drawing, in the order of the rules; empty without a numeric column."""
    plan: list[tuple] = []
    if numeric_cols(df):
        found = _slots(df)
        for kind, x, y, color, title in _CHART_RULES:
            if all(slot in found for slot in (x, y) if slot):
                at = {"x": found.get(x), "y": found.get(y)}
                shown = (None, None) if kind in _WHOLE_TABLE else (at["x"], at["y"])
                plan.append((len(plan) + 1, title.format(**at), kind, *shown, found.get(color.lstrip("*"))))
    return rows(df.sparkSession, plan[:limit], _PLAN_SCHEMA)


_INSIGHT_SCHEMA = "kind string, subject string, metric string, value double, label string, message string"


def _histogram_facts(df: DataFrame, x: str, y: str | None) -> tuple[str, dict]:
    v = clean_number(x)
    f = df.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.skewness(v).alias("s"))
    f = f.first().asDict()
    f["skew"] = corrected_skew(f.pop("s"), f["n"]) or 0.0
    f["shape"] = "symmetric" if abs(f["skew"]) <= 0.5 else f"{'right' if f['skew'] > 0 else 'left'}-skewed"
    return x, f if f["n"] else {}


def _bar_facts(df: DataFrame, x: str, y: str | None) -> tuple[str, dict]:
    known = df.select(col(x).cast("string").alias("x"), clean_number(y).alias("y")).where("x IS NOT NULL")
    means = known.groupBy("x").agg(F.avg("y").alias("v"))
    f = means.where("v IS NOT NULL").agg(F.max(F.struct("v", "x")).alias("a"), F.min(F.struct("v", "x")).alias("b")).first()
    if f["a"] is None:
        return y, {}
    return y, {"leader": f["a"]["v"], "gap": f["a"]["v"] - f["b"]["v"], "first": f["a"]["x"], "last": f["b"]["x"]}


def _scatter_facts(df: DataFrame, x: str, y: str | None) -> tuple[str, dict]:
    f = df.agg(pearson(clean_number(x), clean_number(y)).alias("r"), F.regr_count(clean_number(x), clean_number(y)).alias("n")).first()
    if f["r"] is None or f["n"] < 5:
        return f"{x}, {y}", {}
    sign = "positive" if f["r"] > 0 else "negative"
    return f"{x}, {y}", {"r": f["r"], "relation": f"{strength_of(f['r'])} {sign}"}


def _missing_facts(df: DataFrame, x: str | None, y: str | None) -> tuple[str, dict]:
    f = df.agg(F.count(F.lit(1)), *[F.count_if(present(df, c).isNull()) for c in df.columns]).first()
    cells = f[0] * len(df.columns)
    return "table", {"missing_pct": round(100.0 * sum(f[1:]) / cells, 1) if cells else 0.0}


# Per kind of chart: its facts, the rows made of them as (metric, fact that labels it), and the sentence.
_READINGS = {
    "histogram": (
        _histogram_facts,
        [("min", None), ("max", None), ("mean", None), ("skew", "shape")],
        "{subject}: {shape} (skew {skew:.2f}), mean {mean:.2f}, between {min:.2f} and {max:.2f}",
    ),
    "bar": (
        _bar_facts,
        [("leader", "first"), ("gap", "last")],
        "{first} leads in {subject} with {leader:.2f} on average; {last} is {gap:.2f} lower",
    ),
    "scatter": (_scatter_facts, [("r", "relation")], "{subject}: {relation}, correlation {r:.2f}"),
    "missing": (_missing_facts, [("missing_pct", None)], "cells without a value: {missing_pct}%"),
}


def chart_insight(df: DataFrame, kind: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """What a chart shows, as rows (kind, subject, metric, value, label, message)."""
    subject, facts, lines, text = x, {}, [], ""
    if kind in _READINGS:
        gather, lines, text = _READINGS[kind]
        subject, facts = gather(df, x, y)
    if not facts:
        return rows(df.sparkSession, [(kind, x, None, None, None, "no finding")], _INSIGHT_SCHEMA)
    message = text.format(subject=subject, **facts)
    found = [(kind, subject, metric, float(facts[metric]), facts.get(label), message) for metric, label in lines]
    return rows(df.sparkSession, found, _INSIGHT_SCHEMA)


# --- results of other operators, reduced to what a chart needs ---------------------------


def pca_points(scores: DataFrame, color: str | None = None, n: int | None = None) -> DataFrame:
    return _drawn(_points(scores, ["PC1", "PC2"], color), n)


def cluster_points(labelled: DataFrame, x: str, y: str, label: str = "cluster", n: int | None = None) -> DataFrame:
    """The label is a column of the table, so dropping incomplete rows cannot misalign it."""
    return _drawn(_points(labelled, [x, y, label]), n)


def anomaly_points(flagged: DataFrame, x: str, y: str, n: int | None = None) -> DataFrame:
    shown = flagged.select(col(x), col(y), "is_anomaly", "anomaly_reason").dropna(subset=[x, y])
    return _drawn(shown, n)


def importance_bars(importance: DataFrame, top: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(top)


def seasonal_lines(parts: DataFrame) -> DataFrame:
    """(day, component, value) of a decomposition, in long form."""
    entries = [
        F.struct(F.lit(c).alias("component"), F.col(c).alias("value"))
        for c in ("value", "trend", "seasonal", "resid")
    ]
    others = [c for c in parts.columns if c not in ("value", "trend", "seasonal", "resid")]
    return parts.select(*[col(c) for c in others], F.inline(F.array(*entries)))


def forecast_lines(forecast: DataFrame) -> DataFrame:
    """The forecast as lines: its keys, if it has any, in front of the day and the three values."""
    drawn = ["ds", "yhat", "yhat_lower", "yhat_upper", "is_forecast"]
    keys = [c for c in forecast.columns if c not in drawn]
    return forecast.select(*[col(c) for c in keys], *drawn).orderBy(*[col(c) for c in keys], "ds")
