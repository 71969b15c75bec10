"""Readers and writers."""
from tablescope.sources.readers import read_delimited, read_json, read_parquet, read_table
from tablescope.sources.writers import write_csv, write_json, write_report

__all__ = [
    "read_delimited", "read_json", "read_parquet", "read_table",
    "write_csv", "write_json", "write_report",
]
