"""Cleaning as a fitted plan.

``fit_plan`` looks at the table and writes down, step by step, what has to be
done (column lists, fill values, bounds, kept categories).  ``apply_plan``
replays those literals as projections, plus one ``dropDuplicates``, on any
table with the same columns; every prefix of the plan can be replayed, which
is how an earlier state is restored from the unchanged input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import (
    analysable_cols,
    categorical_cols,
    clean_number,
    col,
    floating_cols,
    numeric_cols,
    rows,
)
from tablescope.plans.frequency import value_frequencies
from tablescope.plans.quantiles import order_statistics, quantiles
from tablescope.plans.storage import materialize

# Texts that stand for a missing value, texts left over from a conversion to text.
NULL_TEXTS = ["", "N/A", "NA", "n/a", "na", "?", "null", "NULL", "-", "NaN", "nan"]
CONVERTED_NULLS = ["nan", "NaN", "None"]
MISSING_CATEGORY = "Unknown"
RARE_CATEGORY = "Other"

_STEPS_BEFORE_BASE = 3
_REPORT_SCHEMA = "step string, column string, metric string, value string"


@dataclass(frozen=True)
class Step:
    """One step of a plan; ``values`` maps columns to the literals the step needs."""

    kind: str
    values: dict = field(default_factory=dict)


@dataclass(frozen=True)
class CleanPlan:
    steps: list[Step]


def _edit(df: DataFrame, edits: dict[str, Column]) -> DataFrame:
    return df.select([edits[c].alias(c) if c in edits else col(c) for c in df.columns])


def _blanked(name: str) -> Column:
    # A cell of other whitespace than blanks counts as empty as well.
    bare = F.regexp_replace(col(name), r"(?U)^\s+|\s+$", "")
    return F.when(~bare.isin(NULL_TEXTS), col(name))


def _tidied(name: str) -> Column:
    text = F.trim(F.regexp_replace(col(name), r"(?U)\s+", " "))
    return F.when(~text.isin(CONVERTED_NULLS), text)


def standardize_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Placeholder texts become NULL."""
    names = categorical_cols(df) if columns is None else columns
    return _edit(df, {c: _blanked(c) for c in names})


def standardize_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Texts are trimmed and runs of whitespace become one blank."""
    names = categorical_cols(df) if columns is None else columns
    return _edit(df, {c: _tidied(c) for c in names})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row; nulls count as equal."""
    return df.dropDuplicates()


def _finite(df: DataFrame, name: str) -> Column:
    return clean_number(name) if name in floating_cols(df) else col(name)


def impute(df: DataFrame, fills: dict) -> DataFrame:
    return _edit(df, {c: F.coalesce(_finite(df, c), F.lit(v)) for c, v in fills.items() if c in df.columns})


def winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values beyond the bounds take the bound; the column keeps its type."""
    edits = {}
    for name, (low, high) in bounds.items():
        if name in df.columns:
            kind = df.schema[name].dataType
            value = col(name)
            edits[name] = F.when(value < low, F.lit(low).cast(kind)).when(
                value > high, F.lit(high).cast(kind)
            ).otherwise(value)
    return _edit(df, edits)


def collapse_rare(df: DataFrame, kept: dict[str, list[str]]) -> DataFrame:
    """Categories outside ``kept`` become one; at most 1 / rare share categories can be kept."""
    edits = {
        c: F.when(col(c).isin(values) | col(c).isNull(), col(c)).otherwise(F.lit(RARE_CATEGORY))
        for c, values in kept.items()
        if c in df.columns
    }
    return _edit(df, edits)


_ACTIONS = {
    "standardize_nulls": lambda df, v: standardize_nulls(df, [c for c in v if c in df.columns]),
    "standardize_text": lambda df, v: standardize_text(df, [c for c in v if c in df.columns]),
    "drop_duplicates": lambda df, v: drop_duplicates(df),
    "drop_columns": lambda df, v: df.drop(*v),
    "impute": impute,
    "winsorize": winsorize,
    "collapse_rare": collapse_rare,
}


def apply_plan(df: DataFrame, plan: CleanPlan, upto: int | None = None) -> DataFrame:
    """Run the first ``upto`` steps of a plan (all by default); lazy."""
    for step in plan.steps[:upto]:
        df = _ACTIONS[step.kind](df, step.values)
    return df


def replay(df: DataFrame, plan: CleanPlan, upto: int) -> DataFrame:
    """The state after the first ``upto`` steps, recomputed from the untouched input."""
    return apply_plan(df, plan, upto)


def text_audit(df: DataFrame) -> DataFrame:
    """(column, placeholders, respaced) for the text columns, before cleaning."""
    names = categorical_cols(df)
    _, found = _text_audit(df, names)
    return rows(
        df.sparkSession,
        [(c, *found[c]) for c in names],
        "column string, placeholders long, respaced long",
    )


def _text_audit(df: DataFrame, names: list[str]) -> tuple[int, dict[str, tuple[int, int]]]:
    """Rows, and per text column the placeholders and respaced texts, in one scan."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        blanked = _blanked(c)
        aggregates += [
            F.count_if(col(c).isNotNull() & blanked.isNull()).alias(f"p{i}"),
            F.count_if(blanked.isNotNull() & (_tidied(c) != col(c))).alias(f"r{i}"),
        ]
    row = df.agg(*aggregates).first()
    return row["rows"], {c: (row[f"p{i}"], row[f"r{i}"]) for i, c in enumerate(names)}


@dataclass(frozen=True)
class ColumnFacts:
    """What the fits need to know about a column; ``frequent`` holds at most 1 / rare share values."""

    missing: int
    distinct: int
    mode: str | None = None
    mode_count: int = 0
    frequent: dict[str, int] = field(default_factory=dict)


def column_facts(df: DataFrame) -> tuple[int, dict[str, ColumnFacts]]:
    """Row count, and per column missing and distinct values, the mode and the frequent values.

    One plain scan and one pass over the value frequencies; ties go to the
    smallest value.
    """
    names = analysable_cols(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(_finite(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    ).first()
    n = counts["rows"]
    entry = F.struct("value", "n")
    is_frequent = F.col("value").isNotNull() & (F.col("n") >= n * SETTINGS.rare_category_frac)
    per_column = (
        value_frequencies(df, names)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("distinct"),
            F.min_by(entry, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))).alias("mode"),
            F.collect_list(F.when(is_frequent, entry)).alias("frequent"),
        )
    )
    found = {r["column"]: r for r in per_column.collect()}
    facts = {}
    for i, c in enumerate(df.columns):
        missing = n - counts[f"n{i}"]
        if c in found:
            r = found[c]
            frequent = {e["value"]: e["n"] for e in r["frequent"]}
            facts[c] = ColumnFacts(missing, r["distinct"], r["mode"]["value"], r["mode"]["n"], frequent)
        else:
            # Lists and maps are not compared; they never count as constant.
            facts[c] = ColumnFacts(missing, 0 if c in names else n - missing)
    return n, facts


def sparse_and_constant(n: int, facts: dict[str, ColumnFacts]) -> dict[str, str]:
    """Columns to drop, with the reason."""
    if n == 0:
        return {}
    dropped = {}
    for name, fact in facts.items():
        if fact.missing / n > SETTINGS.sparse_missing_frac:
            dropped[name] = "sparse"
        elif fact.distinct <= 1:
            dropped[name] = "constant"
    return dropped


def winsor_bounds(df: DataFrame, names: list[str], n: int) -> dict[str, tuple[float, float]]:
    """Order statistics k and n-k-1 with k = floor(share x n), for columns without nulls."""
    k = int(SETTINGS.winsor_frac * n)
    if not names or n == 0:
        return {}
    found = order_statistics(df, {c: [k, n - k - 1] for c in names}, {c: n for c in names})
    return {c: (found[c][k], found[c][n - k - 1]) for c in names}


def fit_plan(df: DataFrame) -> tuple[CleanPlan, DataFrame]:
    """Decide every cleaning step; returns the plan and the report (step, column, metric, value)."""
    plan, report, _ = _fit(df)
    return plan, report


def clean_upto(df: DataFrame, upto: int) -> DataFrame:
    """The state after the first ``upto`` steps (the de-duplication at least); later steps are not fitted."""
    plan, _, base = _fit(df, upto)
    return apply_plan(base, CleanPlan(plan.steps[_STEPS_BEFORE_BASE:upto]))


def _fit(df: DataFrame, upto: int | None = None) -> tuple[CleanPlan, DataFrame, DataFrame]:
    """The plan (its first ``upto`` steps at least), the report and the de-duplicated table.

    The latter is written once to the shared folder, so that later fits and
    steps read it back instead of repeating the full-row shuffle.
    """
    report: list[tuple[str, str | None, str, str]] = []

    def note(step: str, column: str | None, metric: str, value) -> None:
        report.append((step, column, metric, str(value)))

    texts = categorical_cols(df)
    before, audit = _text_audit(df, texts)
    for name, (placeholders, respaced) in audit.items():
        if placeholders:
            note("standardize_nulls", name, "replaced", placeholders)
        if respaced:
            note("standardize_text", name, "changed", respaced)
    steps = [
        Step("standardize_nulls", {c: True for c in texts}),
        Step("standardize_text", {c: True for c in texts}),
        Step("drop_duplicates"),
    ]
    base = materialize(apply_plan(df, CleanPlan(steps)))

    n, facts = column_facts(base)
    note("drop_duplicates", None, "rows_before", before)
    note("drop_duplicates", None, "rows_removed", before - n)
    note("drop_duplicates", None, "rows_after", n)

    dropped = sparse_and_constant(n, facts)
    steps.append(Step("drop_columns", dropped))
    for name, reason in dropped.items():
        note("drop_columns", name, "reason", reason)
    kept = base.drop(*dropped)
    numbers, words = numeric_cols(kept), categorical_cols(kept)
    for name in numbers:
        if n and facts[name].distinct / n < SETTINGS.near_zero_variance_frac:
            note("drop_columns", name, "near_zero_variance", facts[name].distinct)

    gaps = [c for c in numbers if facts[c].missing]
    text_gaps = [c for c in words if facts[c].missing]
    medians = {c: q[0] for c, q in quantiles(kept, gaps, [0.5]).items()}
    fills: dict = {c: 0.0 if medians[c] is None else medians[c] for c in gaps}
    fills |= {c: MISSING_CATEGORY if facts[c].mode is None else facts[c].mode for c in text_gaps}
    steps.append(Step("impute", fills))
    for name, value in fills.items():
        note("impute", name, "filled", facts[name].missing)
        note("impute", name, "value", f"{value:.4f}" if isinstance(value, float) else value)
    if upto is not None and upto <= len(steps):
        return CleanPlan(steps), rows(df.sparkSession, report, _REPORT_SCHEMA), base

    filled = impute(kept, fills)
    wide = [c for c in numbers if _distinct_after_fill(kept, c, facts[c], fills) >= 5]
    bounds = winsor_bounds(filled, wide, n)
    changed = _count_outside(filled, bounds)
    steps.append(Step("winsorize", {c: b for c, b in bounds.items() if changed[c]}))
    for name, count in changed.items():
        if count:
            note("winsorize", name, "changed", count)
            note("winsorize", name, "low", bounds[name][0])
            note("winsorize", name, "high", bounds[name][1])
    if upto is not None and upto <= len(steps):
        return CleanPlan(steps), rows(df.sparkSession, report, _REPORT_SCHEMA), base

    collapse = {}
    for name in words:
        fact, common = facts[name], dict(facts[name].frequent)
        if name in fills:
            filled_rows = fact.missing + fact.mode_count
            if filled_rows >= n * SETTINGS.rare_category_frac:
                common[fills[name]] = filled_rows
        if fact.distinct > 2 and common and len(common) < fact.distinct:
            collapse[name] = sorted(common)
            note("collapse_rare", name, "collapsed", fact.distinct - len(common))
    steps.append(Step("collapse_rare", collapse))
    note("summary", None, "columns_before", len(df.columns))
    note("summary", None, "columns_after", len(kept.columns))
    return CleanPlan(steps), rows(df.sparkSession, report, _REPORT_SCHEMA), base


def _distinct_after_fill(df: DataFrame, name: str, fact: ColumnFacts, fills: dict) -> int:
    if name not in fills or fact.distinct != 4:
        return fact.distinct
    known = df.filter(col(name) == fills[name]).limit(1).count()
    return fact.distinct + (0 if known else 1)


def _count_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    if not bounds:
        return {}
    row = df.agg(
        *[
            F.count_if((col(c) < low) | (col(c) > high)).alias(f"n{i}")
            for i, (c, (low, high)) in enumerate(bounds.items())
        ]
    ).first()
    return {c: row[f"n{i}"] for i, c in enumerate(bounds)}


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and the report of what was done."""
    plan, report, base = _fit(df)
    return apply_plan(base, CleanPlan(plan.steps[_STEPS_BEFORE_BASE:])), report
