"""Apply a cleaning plan, fitted on a batch table, to a stream of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablescope.operators.clean import CleanPlan, apply_plan


def clean_stream(
    stream: DataFrame, plan: CleanPlan, event_time: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Stateless steps run as they are.

    Duplicates are dropped within the watermark of ``event_time``, which keeps
    the state bounded; without an event time they pass.
    """
    first = [s for s in plan.steps if s.kind in ("standardize_nulls", "standardize_text")]
    rest = [s for s in plan.steps if s not in first and s.kind != "drop_duplicates"]
    tidy = apply_plan(stream, CleanPlan(first))
    if event_time is not None:
        tidy = tidy.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark()
    return apply_plan(tidy, CleanPlan(rest))
