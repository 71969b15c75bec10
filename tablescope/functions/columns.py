"""Schema checks and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.errors import ValidationError


def col(name: str) -> Column:
    """Reference a column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _names(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_cols(df: DataFrame) -> list[str]:
    return _names(df, T.NumericType)


def integer_cols(df: DataFrame) -> list[str]:
    return _names(df, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def floating_cols(df: DataFrame) -> list[str]:
    return _names(df, T.FloatType, T.DoubleType)


def categorical_cols(df: DataFrame) -> list[str]:
    return _names(df, T.StringType, T.CharType, T.VarcharType)


def datetime_cols(df: DataFrame) -> list[str]:
    return _names(df, T.TimestampType, T.TimestampNTZType, T.DateType)


def boolean_cols(df: DataFrame) -> list[str]:
    return _names(df, T.BooleanType)


def analysable_cols(df: DataFrame) -> list[str]:
    """Columns with a scalar, comparable type (arrays, maps and structs are passed through)."""
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    ]


def existing_columns(df: DataFrame, names: list[str]) -> list[str]:
    present = set(df.columns)
    return [n for n in names if n in present]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValidationError(f"No such column: {', '.join(missing)}")


def require_numeric(df: DataFrame, name: str) -> None:
    require_columns(df, name)
    if name not in numeric_cols(df):
        raise ValidationError(f"Column {name!r} holds {df.schema[name].dataType.simpleString()}, not numbers")


def clean_number(name: str, df: DataFrame | None = None) -> Column:
    """The column as double with NaN and infinities turned into NULL."""
    value = col(name).cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def exact_number(df: DataFrame, name: str) -> Column:
    """Whole numbers as long and decimals as they are; any other number as in ``clean_number``."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return col(name).cast("long")
    return col(name) if isinstance(kind, T.DecimalType) else clean_number(name)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN, which counts as missing, turned into NULL."""
    if name in floating_cols(df):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate over complete pairs, NULL where one side is constant.

    Spark's ``corr`` fails on a constant column under ANSI rules.
    """
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A result table of driver-side aggregates; its size is bounded by columns, never by rows."""
    return spark.createDataFrame(data, schema).coalesce(1)


def stack_rows(df: DataFrame, entries: list[Column]) -> DataFrame:
    """Turn the single row of an aggregate into one row per struct in ``entries``."""
    return df.select(F.inline(F.array(*entries)))
