"""Data quality scores and the profile of a whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import categorical_cols, col, datetime_cols, floating_cols, numeric_cols, present, rows
from tablescope.operators.ingest import duplicate_rows
from tablescope.operators.semantics import column_profile

# Domains and the words in column names that speak for them.
DOMAIN_KEYWORDS = {
    "Sales / Retail": [
        "revenue", "sales", "units_sold", "discount", "sku", "order",
        "product", "category", "region", "returns", "price", "cart",
    ],
    "Finance / Banking": [
        "balance", "transaction", "account", "interest", "loan",
        "credit", "debit", "apr", "emi", "fraud", "currency",
    ],
    "Marketing": [
        "campaign", "impressions", "clicks", "ctr", "conversion", "cpc",
        "cpa", "roas", "channel", "lead", "engagement",
    ],
    "HR / Workforce": [
        "employee", "salary", "attrition", "department", "tenure",
        "performance_rating", "hire_date", "manager", "job_role",
    ],
    "Healthcare": [
        "patient", "diagnosis", "treatment", "hospital", "physician",
        "bmi", "blood_pressure", "icd", "dosage", "symptom",
    ],
    "Manufacturing": [
        "machine", "downtime", "defect", "batch", "yield",
        "production_line", "shift", "throughput", "scrap",
    ],
    "Telecom": [
        "call_duration", "churn", "subscriber", "network", "data_usage",
        "sim", "plan", "roaming",
    ],
    "Logistics": [
        "shipment", "warehouse", "route", "delivery", "carrier",
        "freight", "tracking", "eta", "fleet",
    ],
    "Education": [
        "student", "grade", "gpa", "course", "enrollment", "attendance",
        "exam", "teacher", "school",
    ],
    "Insurance": [
        "policy", "premium", "claim", "underwriting", "deductible",
        "coverage", "beneficiary",
    ],
    "IoT / Sensor": [
        "sensor", "temperature", "humidity", "voltage", "signal",
        "device_id", "reading", "telemetry",
    ],
    "E-commerce": [
        "cart", "checkout", "sku", "add_to_cart", "session", "wishlist",
        "customer_id", "order_id",
    ],
}
GENERIC = "Generic"


def completeness(df: DataFrame) -> DataFrame:
    """One row ``score``: 100 x non-null cells / cells, 0 for an empty table."""
    filled = sum((F.count(present(df, c)) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(F.coalesce(F.try_divide(100.0 * filled, cells), F.lit(0.0)).alias("score"))


def quality_score(df: DataFrame) -> DataFrame:
    return completeness(df).withColumn("score", F.round("score", 1))


def uniqueness(df: DataFrame) -> DataFrame:
    """One row ``score``: 100 x the share of rows that do not repeat an earlier row."""
    return duplicate_rows(df).select(
        F.coalesce(100.0 * F.try_divide("distinct_rows", "rows"), F.lit(100.0)).alias("score")
    )


def _penalty():
    recased = (F.col("semantic_type") == "categorical") & (F.col("n_unique") > F.col("n_lowered"))
    return F.when(F.col("semantic_type") == "mixed", 1.0).when(recased, 0.3).otherwise(0.0)


def consistency(df: DataFrame) -> DataFrame:
    """One row ``score``: columns of mixed values cost 1, categories in several casings 0.3."""
    score = 100.0 - 100.0 * F.sum(_penalty()) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return column_profile(df).agg(F.greatest(F.lit(0.0), F.coalesce(score, F.lit(100.0))).alias("score"))


def validity(df: DataFrame) -> DataFrame:
    """One row ``score``: 100 x the share of numeric cells that are not infinite.

    Score the raw table: normalising turns infinities into nulls.
    """
    infinite = sum((F.count_if(F.abs(col(c)) == float("inf")) for c in floating_cols(df)), F.lit(0))
    cells = F.count(F.lit(1)) * len(numeric_cols(df))
    return df.agg(F.coalesce(100.0 * (1.0 - F.try_divide(infinite, cells)), F.lit(100.0)).alias("score"))


def profile_summary(df: DataFrame, profile: DataFrame) -> dict:
    """The table profile as plain values; ``profile`` is the table's column profile, stored or lazy."""
    number = F.col("kind") == "number"
    facts = profile.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("rows"),
        F.sum(F.col("n_rows") - F.col("n_missing")).alias("present"),
        F.sum("n_rows").alias("cells"),
        F.sum(_penalty()).alias("penalty"),
        F.count(F.lit(1)).alias("columns"),
        F.sum(F.when(number, F.col("n_infinite"))).alias("infinite"),
        F.sum(F.when(number, F.col("n_rows"))).alias("numeric_cells"),
        F.count_if(F.col("semantic_type") == "constant").alias("constant_columns"),
        F.count_if(F.col("n_unique") > SETTINGS.high_cardinality).alias("high_cardinality_columns"),
    ).first()
    repeats = duplicate_rows(df).first()
    complete = round(100.0 * facts["present"] / facts["cells"], 1) if facts["cells"] else 0.0
    unique = round(100.0 * repeats["distinct_rows"] / repeats["rows"], 1) if repeats["rows"] else 100.0
    consistent = 100.0 - 100.0 * (facts["penalty"] or 0.0) / facts["columns"] if facts["columns"] else 100.0
    consistent = round(max(0.0, min(100.0, consistent)), 1)
    valid = round(100.0 * (1 - (facts["infinite"] or 0) / facts["numeric_cells"]), 1) if facts["numeric_cells"] else 100.0
    overall = (
        SETTINGS.weight_completeness * complete
        + SETTINGS.weight_uniqueness * unique
        + SETTINGS.weight_consistency * consistent
        + SETTINGS.weight_validity * valid
    )
    return {
        "rows": facts["rows"],
        "columns": len(df.columns),
        "duplicate_rows": repeats["duplicate_rows"],
        "constant_columns": facts["constant_columns"],
        "high_cardinality_columns": facts["high_cardinality_columns"],
        "numeric_columns": len(numeric_cols(df)),
        "categorical_columns": len(categorical_cols(df)),
        "datetime_columns": len(datetime_cols(df)),
        "completeness": complete,
        "uniqueness": unique,
        "consistency": consistent,
        "validity": valid,
        "overall": round(overall, 1),
    }


_SUMMARY_SCHEMA = (
    "rows long, columns long, duplicate_rows long, constant_columns long, high_cardinality_columns long, "
    "numeric_columns long, categorical_columns long, datetime_columns long, completeness double, "
    "uniqueness double, consistency double, validity double, overall double"
)


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row with the table's shape, column kinds, duplicates and quality scores."""
    summary = profile_summary(df, column_profile(df))
    return rows(df.sparkSession, [tuple(summary.values())], _SUMMARY_SCHEMA)


def catalog(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(table, column) for a set of DataFrames."""
    return rows(spark, [(n, c) for n, t in tables.items() for c in t.columns], "table string, column string")


def _any_of(words: list[str]) -> str:
    """Pattern that finds any of the words; shared beginnings are tried once."""
    if "" in words:
        return ""
    branches = []
    for first in sorted({w[0] for w in words}):
        rest = _any_of([w[1:] for w in words if w[0] == first])
        branches.append(re.escape(first) + rest)
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def domain_scores(catalog_df: DataFrame) -> DataFrame:
    """Per table the domain whose keywords occur in most of its column names.

    ``catalog_df`` holds (table, column).  Each name is tested against the
    keyword list in place and only the keywords found are shuffled, so a table
    with any number of columns is never gathered in one task.
    """
    words = [
        F.struct(
            F.lit(rank).alias("rank"),
            F.lit(domain).alias("domain"),
            F.lit(word).alias("keyword"),
            F.lit(word.replace("_", " ")).alias("needle"),
        )
        for rank, (domain, bank) in enumerate(DOMAIN_KEYWORDS.items())
        for word in bank
    ]
    # Names without any keyword, the great majority, are dropped before the first shuffle.
    any_word = _any_of([w.replace("_", " ") for bank in DOMAIN_KEYWORDS.values() for w in bank])
    names = (
        catalog_df.select("table", F.replace(F.lower("column"), F.lit("_"), F.lit(" ")).alias("name"))
        .filter(F.col("name").rlike(any_word))
        .distinct()
    )
    found = F.filter(F.array(*words), lambda w: F.contains(F.col("name"), w["needle"]))
    sizes = catalog_df.groupBy("table").agg(F.count(F.lit(1)).alias("columns"))
    hits = (
        names.select("table", F.explode(found).alias("hit"))
        .groupBy("table", "hit")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("table", "hit.rank", "hit.domain")
        .agg(F.count(F.lit(1)).alias("hits"), F.sort_array(F.collect_list("hit.keyword")).alias("keywords"))
    )
    # At most one row per domain and table from here on.
    order = F.struct((-F.col("hits")).alias("h"), F.col("rank"))
    ranked = hits.groupBy("table").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "domain", "hits", "keywords"))).alias("r")
    )
    best = F.get("r", F.lit(0))
    share = F.col("hits") / F.greatest(F.col("columns") * 0.3, F.lit(1.0))
    return (
        sizes.join(ranked, "table", "left")
        .withColumn("hits", F.coalesce(best["hits"], F.lit(0).cast("long")))
        .select(
            "table",
            F.coalesce(best["domain"], F.lit(GENERIC)).alias("domain"),
            F.round(F.least(F.lit(1.0), share), 2).alias("confidence"),
            "hits",
            best["keywords"].alias("keywords"),
            F.get("r", F.lit(1))["domain"].alias("runner_up"),
        )
    )


def detect_domain(df: DataFrame) -> DataFrame:
    return domain_scores(catalog({"table": df}, df.sparkSession)).drop("table")


def compare_datasets(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: row and column counts, names in both, names in one only, row difference."""
    ours, theirs = set(left.columns), set(right.columns)

    def names(chosen: set[str]):
        return F.array(*[F.lit(n) for n in sorted(chosen)]).cast("array<string>")

    counts = left.agg(F.count(F.lit(1)).alias("left_rows"), F.lit(0).cast("long").alias("right_rows")).unionAll(
        right.agg(F.lit(0).cast("long").alias("left_rows"), F.count(F.lit(1)).alias("right_rows"))
    )
    return counts.agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows")).select(
        "left_rows",
        "right_rows",
        F.lit(len(left.columns)).cast("long").alias("left_columns"),
        F.lit(len(right.columns)).cast("long").alias("right_columns"),
        names(ours & theirs).alias("shared"),
        names(ours - theirs).alias("left_only"),
        names(theirs - ours).alias("right_only"),
        (F.col("right_rows") - F.col("left_rows")).alias("row_delta"),
    )
