"""Semantic column types and the per-column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import (
    analysable_cols,
    boolean_cols,
    categorical_cols,
    clean_number,
    col,
    datetime_cols,
    integer_cols,
    numeric_cols,
    stack_rows,
)
from tablescope.plans.frequency import value_frequencies

# Semantic types, words that mark an ordinal scale, name parts that mark an identifier.
SEMANTIC_TYPES = [
    "numeric", "categorical", "binary", "ordinal", "datetime", "boolean", "id", "text", "constant", "mixed",
]
ORDINAL_WORDS = [
    "low", "medium", "high", "small", "large", "poor", "fair", "good", "excellent",
    "bronze", "silver", "gold", "platinum", "junior", "senior", "beginner",
    "intermediate", "advanced", "expert",
]
ID_NAME_PARTS = ["id", "_id", "uuid", "code", "key", "index", "no.", "number"]

_MAX_ORDINAL_WORDS = 12
_MAX_ORDINAL_LEVELS = 10
_MAX_ORDINAL_SPAN = 20
_SAMPLES = 5


def _kind_of(df: DataFrame, name: str) -> str:
    for kind, members in (
        ("boolean", boolean_cols(df)),
        ("datetime", datetime_cols(df)),
        ("number", numeric_cols(df)),
        ("text", categorical_cols(df)),
    ):
        if name in members:
            return kind
    return "other"


def column_counts(df: DataFrame) -> DataFrame:
    """One scan: kind, dtype, rows, missing, infinities and the numeric range of each column."""
    whole = set(integer_cols(df))
    aggregates, entries = [F.count(F.lit(1)).alias("n_rows")], []
    for i, name in enumerate(df.columns):
        aggregates.append(F.count(col(name)).alias(f"n{i}"))
        kind = _kind_of(df, name)
        if kind == "number":
            raw = col(name).cast("double")
            aggregates += [
                F.min(clean_number(name)).alias(f"low{i}"),
                F.max(clean_number(name)).alias(f"high{i}"),
                F.count_if(F.abs(raw) == float("inf")).alias(f"inf{i}"),
                F.count_if(F.isnan(raw)).alias(f"nan{i}"),
            ]
            extras = [F.col(f"low{i}"), F.col(f"high{i}"), F.col(f"inf{i}")]
            present = F.col(f"n{i}") - F.col(f"nan{i}")
        else:
            extras = [F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0).cast("long")]
            present = F.col(f"n{i}")
        low, high, infinities = extras
        entries.append(
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(name).alias("column"),
                F.lit(kind).alias("kind"),
                F.lit(name in whole).alias("is_whole"),
                F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
                F.col("n_rows"),
                (F.col("n_rows") - present).alias("n_missing"),
                low.alias("low"),
                high.alias("high"),
                infinities.alias("n_infinite"),
            )
        )
    return stack_rows(df.agg(*aggregates), entries)


def value_counts_summary(freq: DataFrame) -> DataFrame:
    """Per text column: casing variants, ordinal words, average length.

    Group-bys on shrinking inputs: lower-cased values, then trimmed ones.  The
    filter also looks at the count, so that it stays above the frequencies and
    all summaries read the same shuffle.
    """
    lowered = (
        freq.filter(F.when(F.col("n") > 0, F.col("value")).isNotNull())
        .groupBy("column", F.lower("value").alias("value"))
        .agg(F.sum("n").alias("n"), F.sum(F.length("value") * F.col("n")).alias("chars"))
    )
    trimmed = lowered.groupBy("column", F.trim("value").alias("value")).agg(
        F.count(F.lit(1)).alias("lowered"), F.sum("n").alias("n"), F.sum("chars").alias("chars")
    )
    return trimmed.groupBy("column").agg(
        F.sum("lowered").alias("n_lowered"),
        F.count(F.lit(1)).alias("n_words"),
        F.count_if(F.col("value").isin(ORDINAL_WORDS)).alias("n_ordinal_words"),
        (F.sum("chars") / F.sum("n")).alias("avg_len"),
    )


def distinct_summary(freq: DataFrame) -> DataFrame:
    """Distinct values per column; the counts are read for the sake of the shared shuffle."""
    return freq.groupBy("column").agg(F.when(F.sum("n") > 0, F.count(F.lit(1))).alias("n_unique"))


def sample_values(freq: DataFrame, n: int = _SAMPLES) -> DataFrame:
    """The ``n`` smallest distinct values of each column; ranked per task before the shuffle."""
    order = ["whole", "real", "moment", "value"]
    smallest = Window.partitionBy("column").orderBy(*order)
    shown = F.coalesce(*[F.col(slot).cast("string") for slot in order])
    ranked = freq.withColumn("_place", F.row_number().over(smallest)).filter(F.col("_place") <= n)
    listed = F.when(F.col("n") > 0, F.struct("_place", shown.alias("shown")))
    return (
        ranked.groupBy("column")
        .agg(F.sort_array(F.collect_list(listed)).alias("_r"))
        .select("column", F.col("_r.shown").alias("samples"))
    )


def looks_like_id() -> Column:
    """Over the columns of a profile: nearly all values differ and the name says so, or all differ."""
    ratio = F.col("n_unique") / (F.col("n_rows") - F.col("n_missing"))
    named = F.lit(False)
    for part in ID_NAME_PARTS:
        named = named | F.lower("column").contains(part)
    return (ratio >= SETTINGS.id_uniqueness_ratio) & (named | (ratio == 1.0))


def looks_ordinal() -> Column:
    return (F.col("n_words") <= _MAX_ORDINAL_WORDS) & (F.col("n_ordinal_words") >= 2)


def semantic_type() -> Column:
    """The first rule that holds, over the columns of a profile."""
    ratio = F.col("n_unique") / (F.col("n_rows") - F.col("n_missing"))
    is_number = F.col("kind") == "number"
    spread = (ratio > SETTINGS.categorical_max_unique_ratio) & (
        F.col("n_unique") > SETTINGS.categorical_max_unique_abs
    )
    levels = (
        F.col("is_whole")
        & (F.col("n_missing") == 0)
        & (F.col("n_unique") <= _MAX_ORDINAL_LEVELS)
        & (F.col("low") >= 0)
        & (F.col("high") - F.col("low") <= _MAX_ORDINAL_SPAN)
    )
    return (
        F.when(F.col("n_unique") <= 1, "constant")
        .when(F.col("kind").isin("boolean", "datetime"), F.col("kind"))
        .when(F.col("n_unique") == 2, "binary")
        .when(looks_like_id(), "id")
        .when(is_number & levels, "ordinal")
        .when(is_number, "numeric")
        .when(looks_ordinal(), "ordinal")
        .when(spread & (F.col("avg_len") > SETTINGS.text_avg_len), "text")
        .when(spread, "mixed")
        .otherwise("categorical")
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row per analysable column with counts, semantic type and sample values."""
    names = analysable_cols(df)
    table = df.select(*[col(c) for c in names])
    freq = value_frequencies(table, names)
    return (
        column_counts(table)
        .join(distinct_summary(freq), "column", "left")
        .join(value_counts_summary(freq), "column", "left")
        .join(sample_values(freq), "column", "left")
        .fillna(0, ["n_unique", "n_lowered", "n_words", "n_ordinal_words"])
        .withColumn("semantic_type", semantic_type())
        .withColumn("missing_pct", F.round(100 * F.try_divide("n_missing", "n_rows"), 1))
        .fillna(0.0, ["missing_pct"])
    )


def infer_semantic_types(df: DataFrame) -> DataFrame:
    return column_profile(df).select("column", "semantic_type")


def build_schema(df: DataFrame) -> DataFrame:
    """(column, semantic_type, dtype, n_unique, n_missing, missing_pct, samples)."""
    return column_profile(df).select(
        "column", "semantic_type", "dtype", "n_unique", "n_missing", "missing_pct", "samples"
    )


def columns_of_type(schema: DataFrame, *types: str) -> DataFrame:
    return schema.filter(F.col("semantic_type").isin(*types)).select("column")
