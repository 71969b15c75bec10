"""Value frequencies: one shuffle of distinct values that serves many operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.config import SETTINGS
from tablescope.functions.columns import col, present


def _typed(df: DataFrame, name: str) -> dict[str, Column]:
    """The value in the one slot that holds it without loss or costly conversion."""
    kind, value = df.schema[name].dataType, col(name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return {"whole": value.cast("long")}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return {"real": present(df, name).cast("double")}
    if isinstance(kind, T.TimestampNTZType):
        return {"moment": value}
    return {"value": value.cast("string")}


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, whole, real, moment, n) for every non-null value of ``columns``.

    Exactly one of the four value slots is filled: ``value`` for text and
    everything else that is compared as text.  Rows are combined before the
    shuffle, so a value that fills a third of the table still crosses the
    network once per map task.
    """
    slots = {"value": "string", "whole": "long", "real": "double", "moment": "timestamp_ntz"}
    entries = []
    for name in columns:
        typed = _typed(df, name)
        filled = [typed.get(s, F.lit(None).cast(t)).alias(s) for s, t in slots.items()]
        entries.append(F.struct(F.lit(name).alias("column"), *filled))
    return (
        df.select(F.inline(F.array(*entries)))
        .filter(reduce(or_, [F.col(s).isNotNull() for s in slots]))
        .groupBy("column", *slots)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact number of distinct non-null values per column."""
    if not columns:
        return {}
    found = value_frequencies(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["column"]: r["n"] for r in found}
    return {c: counts.get(c, 0) for c in columns}


def few_valued(df: DataFrame, columns: list[str], limit: int) -> dict[str, dict]:
    """Rows per value, null included, of the columns with 1 to ``limit`` distinct values.

    A sketch sets aside columns that are far beyond the limit, so that long
    texts are not shuffled only to find out that there are many of them; the
    rest are counted exactly.
    """
    if not columns:
        return {}
    rough = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if 0 < rough[f"d{i}"] <= 3 * limit + 10]
    if not near:
        return {}
    entries = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in near]
    tall = df.select(F.inline(F.array(*entries))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict] = {c: {} for c in near}
    for r in tall.collect():  # at most a few times the limit per column
        counts[r["column"]][r["value"]] = r["n"]
    return {c: v for c, v in counts.items() if len(v.keys() - {None}) <= limit}


def _bucket_cuts(values: DataFrame, value: str, rows_per_bucket: int) -> list[float]:
    """Cut points that split the rows of ``values`` into even ranges; none while one range is enough."""

    def sketch(buckets: int):
        shares = [i / buckets for i in range(1, buckets)]
        return F.percentile_approx(value, shares, 4 * buckets).alias("cuts")

    grid = 128
    row = values.agg(F.count(F.lit(1)).alias("n"), sketch(grid)).first()
    wanted = min(-(-row["n"] // rows_per_bucket), SETTINGS.prefix_buckets)
    if wanted <= 1:
        return []
    if wanted > grid:
        return sorted(set(values.agg(sketch(wanted)).first()["cuts"]))
    return sorted(set(row["cuts"][:: grid // wanted]))


def _with_range(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """Add ``_range``, the index of the interval between two cut points that holds the value."""
    splits = [float("-inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_double", outputCol="_range")
    return cut.transform(df.withColumn("_double", F.col(value).cast("double"))).drop("_double")


def cumulative_counts(
    freq: DataFrame, keys: list[str], value: str, rows_per_bucket: int | None = None
) -> DataFrame:
    """Add ``before`` (rows with a smaller value in the same group) and ``total`` (rows of the group).

    ``freq`` has one row per (keys, value) with its count ``n``; ``value`` keeps its type.  Values are cut
    into even ranges, the running sum is taken per (keys, range), and the range
    totals supply the offsets; no task sees a whole group, and a group's offset
    window holds one row per range.
    """
    cuts = _bucket_cuts(freq.select(F.col(value).cast("double").alias(value)), value, rows_per_bucket or SETTINGS.exact_rows)
    by_group = Window.partitionBy(*keys)
    if not cuts:
        running = by_group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return freq.withColumns(
            {"before": F.coalesce(F.sum("n").over(running), F.lit(0)), "total": F.sum("n").over(by_group)}
        )
    cut = _with_range(freq, value, cuts)
    earlier = by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_range")
        .agg(F.sum("n").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .withColumn("total", F.sum("_size").over(by_group))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return (
        cut.withColumn("_inner", running)
        .join(offsets, [*keys, "_range"])
        .withColumn("before", F.col("_offset") + F.col("_inner"))
        .drop("_inner", "_offset", "_range")
    )


def group_quantiles(freq: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(keys..., total, q0, q1, ...): linearly interpolated quantiles per group from (keys, value, n)."""
    placed = cumulative_counts(freq, keys, value)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    ends, answers = [F.max("total").alias("total")], []
    for i, p in enumerate(probabilities):
        spot = (F.col("total") - 1) * F.lit(p)
        for side, rank in (("low", F.floor(spot)), ("high", F.ceil(spot))):
            ends.append(F.max(F.when((first <= rank) & (rank <= last), F.col(value))).alias(f"{side}{i}"))
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        answers.append((low + (high - low) * (spot - F.floor(spot))).alias(f"q{i}"))
    return placed.groupBy(*keys).agg(*ends).select(*keys, "total", *answers)
