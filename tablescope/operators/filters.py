"""Row filters and previews."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import col


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any cell, as text, matches the pattern ``text`` in any casing; blank keeps all."""
    pattern = text.strip()
    if not pattern:
        return df
    return df.filter(
        reduce(or_, [F.coalesce(col(c).cast("string").rlike("(?i)" + pattern), F.lit(False)) for c in df.columns])
    )


def preview(df: DataFrame, n: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; only ``order_by`` makes the choice repeatable."""
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return ordered.limit(SETTINGS.preview_rows if n is None else n)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of the rows in which none of them is null."""
    return df.select(*[col(c) for c in columns]).dropna()


def flagged_rows(df: DataFrame, flag: str = "is_anomaly", score: str = "anomaly_score") -> DataFrame:
    """Flagged rows, highest score first."""
    return df.filter(col(flag)).orderBy(col(score).desc())
