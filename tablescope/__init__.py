"""Table analysis on Spark: load, type, profile, clean, test, model and chart tables of any size.

    from tablescope import sources, operators

    df = operators.ingest.normalise(sources.read_table(spark, "orders.csv")).df
    cleaned, report = operators.clean.clean(df)
    operators.describe.descriptive_stats(cleaned).show()
"""
from tablescope import operators, sources
from tablescope.config import SETTINGS, Settings
from tablescope.errors import CheckpointDirError, ValidationError

__all__ = ["SETTINGS", "CheckpointDirError", "Settings", "ValidationError", "operators", "sources"]
