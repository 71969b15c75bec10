"""Turn a raw table into a typed one, and describe what was found."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.config import SETTINGS
from tablescope.errors import ValidationError
from tablescope.functions.columns import (
    analysable_cols,
    categorical_cols,
    col,
    floating_cols,
    integer_cols,
    numeric_cols,
    present,
    rows,
    stack_rows,
)
from tablescope.functions.parsing import DATE_NAME_HINT, day_order_votes, parse_number, parse_timestamp
from tablescope.plans.copies import draw_rows, row_hashes
from tablescope.plans.frequency import value_frequencies


@dataclass
class Ingested:
    """A normalised table with the notes taken on the way."""

    df: DataFrame
    notes: list[str] = field(default_factory=list)


def dedupe_columns(names: list[str]) -> list[str]:
    """Trimmed names; blanks become ``unnamed``, repeats get ``_1``, ``_2``, ..."""
    taken: set[str] = set()
    unique = []
    for raw in names:
        base = name = str(raw).strip() or "unnamed"
        suffix = 0
        while name.lower() in taken:  # Spark resolves names without regard to case
            suffix += 1
            name = f"{base}_{suffix}"
        taken.add(name.lower())
        unique.append(name)
    return unique


def rename_duplicates(df: DataFrame) -> DataFrame:
    return df.toDF(*dedupe_columns(df.columns))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every cell is null."""
    return df.dropna(how="all")


def _present(df: DataFrame):
    return [F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)]


def empty_columns(df: DataFrame) -> list[str]:
    """Names of columns without a single value; they are reported, not dropped."""
    counts = df.agg(*_present(df)).first()
    return [c for i, c in enumerate(df.columns) if counts[f"n{i}"] == 0]


def coercion_rates(df: DataFrame) -> DataFrame:
    """(column, non_null, parsed): how many texts of each text column read as a number."""
    entries, aggregates = [], []
    for i, name in enumerate(categorical_cols(df)):
        aggregates += [F.count(col(name)).alias(f"n{i}"), F.count(parse_number(col(name))).alias(f"p{i}")]
        entries.append(
            F.struct(
                F.lit(name).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"p{i}").alias("parsed")
            )
        )
    if not entries:
        return rows(df.sparkSession, [], "column string, non_null long, parsed long")
    return stack_rows(df.agg(*aggregates), entries)


@dataclass(frozen=True)
class Choice:
    """Aggregates to take in one scan, and the decision drawn from their row."""

    aggregates: list[Column]
    decide: Callable[[Row], dict[str, object]]


def _numbers_in_text(df: DataFrame, min_success: float | None = None) -> Choice:
    needed = SETTINGS.numeric_success_rate if min_success is None else min_success
    names = categorical_cols(df)
    aggregates = []
    for i, name in enumerate(names):
        aggregates += [
            F.count(col(name)).alias(f"number_of{i}"),
            F.count(parse_number(col(name))).alias(f"number_ok{i}"),
        ]

    def decide(row):
        return {
            c: True
            for i, c in enumerate(names)
            if row[f"number_of{i}"] and row[f"number_ok{i}"] / row[f"number_of{i}"] >= needed
        }

    return Choice(aggregates, decide)


def _dates_in_text(df: DataFrame, layouts: list[str] | None, day_order: str = "value") -> Choice:
    """Columns of dates, each with whether the day stands before the month."""
    if day_order not in ("value", "column"):
        raise ValueError("day_order is 'value' or 'column'")
    names = categorical_cols(df)
    aggregates = []
    for i, name in enumerate(names):
        aggregates += [
            F.count(col(name)).alias(f"date_of{i}"),
            F.count(parse_timestamp(col(name), layouts)).alias(f"date_ok{i}"),
        ]
        if day_order == "column":
            first, second = day_order_votes(col(name))
            aggregates += [F.count_if(first).alias(f"day_first{i}"), F.count_if(second).alias(f"day_second{i}")]

    def decide(row):
        chosen = {}
        for i, c in enumerate(names):
            hinted = re.search(DATE_NAME_HINT, c)
            needed = SETTINGS.datetime_success_rate if hinted else SETTINGS.datetime_success_rate_unhinted
            if row[f"date_of{i}"] and row[f"date_ok{i}"] / row[f"date_of{i}"] >= needed:
                chosen[c] = day_order == "column" and row[f"day_first{i}"] > 0 == row[f"day_second{i}"]
        return chosen

    return Choice(aggregates, decide)


def _widths(df: DataFrame, floats: bool = False) -> Choice:
    whole = integer_cols(df)
    real = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"] if floats else []
    aggregates = []
    for i, name in enumerate(whole):
        aggregates += [F.min(col(name)).alias(f"low{i}"), F.max(col(name)).alias(f"high{i}")]
    for i, name in enumerate(real):
        aggregates.append(F.max(F.abs(col(name) - col(name).cast("float"))).alias(f"loss{i}"))

    def decide(row):
        target = {}
        for i, name in enumerate(whole):
            low, high = row[f"low{i}"], row[f"high{i}"]
            for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)):
                if low is not None and -(1 << bits) <= low and high < (1 << bits):
                    target[name] = kind
                    break
        target |= {name: "float" for i, name in enumerate(real) if row[f"loss{i}"] == 0.0}
        return target

    return Choice(aggregates, decide)


def _taken(df: DataFrame, choice: Choice) -> dict[str, object]:
    return choice.decide(df.agg(*choice.aggregates).first()) if choice.aggregates else {}


def _edited(df: DataFrame, edits: dict[str, Column]) -> DataFrame:
    return df.select([edits[c].alias(c) if c in edits else col(c) for c in df.columns])


def try_coerce_columns(df: DataFrame, min_success: float | None = None) -> DataFrame:
    """Turn a text column into numbers if at least ``min_success`` of its values read as numbers."""
    return _edited(df, {c: parse_number(col(c)) for c in _taken(df, _numbers_in_text(df, min_success))})


def sanitize_infinities(df: DataFrame) -> DataFrame:
    """Infinities and NaN become NULL, the one missing value of this library."""
    odd = set(floating_cols(df))
    return df.select(
        [
            F.when(~F.isnan(col(c)) & (F.abs(col(c)) != float("inf")), col(c)).alias(c) if c in odd else col(c)
            for c in df.columns
        ]
    )


def infer_datetimes(df: DataFrame, layouts: list[str] | None = None, day_order: str = "value") -> DataFrame:
    """Turn text columns into timestamps where enough values parse; other cells become NULL.

    A column whose name hints at dates needs a lower share of readable values.
    ``3/4/2023`` has the month first; with ``day_order="column"`` the day is
    first if some value of the column must be read that way and none the other.
    """
    chosen = _taken(df, _dates_in_text(df, layouts, day_order))
    return _edited(df, {c: parse_timestamp(col(c), layouts, first) for c, first in chosen.items()})


def narrow_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Cast integers to the smallest width that holds them.

    ``floats`` also turns doubles into floats where no value changes.
    """
    return _edited(df, {c: col(c).cast(kind) for c, kind in _taken(df, _widths(df, floats)).items()})


def normalise(df: DataFrame, layouts: list[str] | None = None, day_order: str = "value") -> Ingested:
    """Empty rows, header names, numbers in text, dates in text, infinities, integer widths, in this order.

    One scan decides everything; the result is a filter and a projection.
    """
    named = rename_duplicates(df)
    numbers, dates, widths = _numbers_in_text(named), _dates_in_text(named, layouts, day_order), _widths(named)
    row = named.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(reduce(or_, [col(c).isNotNull() for c in named.columns])).alias("kept"),
        *_present(named),
        *numbers.aggregates,
        *dates.aggregates,
        *widths.aggregates,
    ).first()
    notes = []
    if row["rows"] > row["kept"]:
        notes.append(f"{row['rows'] - row['kept']} empty rows dropped")
    empty = [c for i, c in enumerate(named.columns) if row[f"n{i}"] == 0]
    if empty:
        notes.append(f"columns without values: {', '.join(empty)}")
    edits = {c: col(c).cast(kind) for c, kind in widths.decide(row).items()}
    edits |= {c: parse_timestamp(col(c), layouts, first) for c, first in dates.decide(row).items()}
    edits |= {c: parse_number(col(c)) for c in numbers.decide(row)}  # a number is never read as a date
    typed = _edited(drop_empty_rows(named), edits)
    for name, before, after in zip(named.columns, named.dtypes, typed.dtypes):
        if before != after:
            notes.append(f"{name}: {before[1]} read as {after[1]}")
    return Ingested(sanitize_infinities(typed), notes)


def schema_report(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, nulls, null_pct, cardinality), one row per column."""
    names = analysable_cols(df)
    present = {c: i for i, c in enumerate(df.columns)}
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{present[c]}")).alias("nulls"),
            F.round(100 * (F.col("rows") - F.col(f"n{present[c]}")) / F.col("rows"), 1).alias("null_pct"),
        )
        for c in df.columns
    ]
    base = stack_rows(df.agg(F.count(F.lit(1)).alias("rows"), *_present(df)), entries)
    distinct = (
        value_frequencies(df, names)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("cardinality"))
    )
    return base.join(distinct, "column", "left").withColumn(
        "cardinality", F.coalesce("cardinality", F.lit(0).cast("long"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row (rows, distinct_rows, duplicate_rows); nulls count as equal.

    Rows that agree in both 64-bit hashes are taken for equal.  Only hashes are
    shuffled, combined per task, whether rows repeat or not.
    """
    first, second = row_hashes(df)
    hashed = df.select(first.alias("first"), second.alias("second"))
    counted = hashed.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    total, distinct = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return counted.agg(
        total.alias("rows"), distinct.alias("distinct_rows"), (total - distinct).alias("duplicate_rows")
    )


@dataclass
class Validation:
    valid: bool
    rows: int
    columns: int
    missing_cells: int
    duplicate_rows: int
    numeric_columns: list[str]
    other_columns: list[str]
    issues: list[str]


def validate(df: DataFrame, allow_empty: bool = False) -> Validation:
    """Check that there is something to analyse; duplicates and missing cells are issues, not errors."""
    if not df.columns:
        raise ValidationError("The table has no columns")
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *_present(df)).first()
    n = counts["rows"]
    if n == 0 and not allow_empty:
        raise ValidationError("The table has no rows")
    missing = sum(n - counts[f"n{i}"] for i in range(len(df.columns)))
    repeated = duplicate_rows(df).first()["duplicate_rows"]
    issues = []
    if n == 0:
        issues.append("no rows")
    if repeated:
        issues.append(f"{repeated} duplicate rows")
    if missing:
        issues.append(f"{missing} missing cells")
    numeric = numeric_cols(df)
    return Validation(
        True, n, len(df.columns), missing, repeated, numeric,
        [c for c in df.columns if c not in numeric], issues,
    )


def sample_rows(df: DataFrame, n: int | None = None, seed: int | None = None) -> DataFrame:
    """The table itself up to ``n`` rows, else exactly ``n`` rows drawn with a fixed seed.

    Copies of a row are drawn independently, and the layout of the input does
    not matter (see ``draw_rows``).  Rows with maps cannot be compared.
    """
    n = SETTINGS.sample_rows if n is None else n
    seed = SETTINGS.seed if seed is None else seed
    total = df.count()
    if total <= n:
        return df
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields):
        raise ValidationError("Rows with maps cannot be compared; drop those columns before sampling")
    return draw_rows(df, seed, (n + 10 * math.sqrt(n) + 100) / total, n)
