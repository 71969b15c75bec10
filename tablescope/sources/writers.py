"""Write result tables; every writer is a distributed Spark write to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quotes are doubled and blanks kept, as ``read_delimited`` expects them."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line, dates in ISO form, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_report(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One parquet folder per named table."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")
