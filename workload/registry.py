"""Bookkeeping for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables under one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def messy_orders(self) -> DataFrame:
        return self.spark.sql(MESSY_ORDERS.replace("FROM orders", "FROM {orders}"), orders=self.orders)


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double so that summation order does not show."""
    return df.select(
        [
            F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def texts(df: DataFrame, *names: str) -> DataFrame:
    """Show dates and lists as text, which both engines print alike."""
    shown = {}
    for name in names:
        kind = dict(df.dtypes)[name]
        shown[name] = F.array_join(name, ",") if kind.startswith("array") else F.col(name).cast("string")
    return df.withColumns(shown)


# The orders table with planted faults; the same text runs in Spark and DuckDB.
MESSY_ORDERS = """
WITH base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price_txt,
         CAST(year(o_orderdate) AS STRING) AS yy,
         lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm,
         lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd
  FROM orders
), messy AS (
  SELECT o_orderkey AS order_id,
         o_custkey  AS customer_id,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              WHEN o_orderkey % 3 = 0 THEN '$' || price_txt
              WHEN o_orderkey % 5 = 0 THEN price_txt || '%'
              ELSE price_txt END AS revenue_txt,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL
              WHEN o_orderkey % 101 = 0 THEN o_totalprice * 40
              ELSE o_totalprice END AS amount,
         CASE WHEN o_orderkey % 11 = 0 THEN 'N/A'
              WHEN o_orderkey % 7 = 0 THEN '  ' || o_orderpriority || '   '
              WHEN o_orderkey % 97 = 0 THEN 'rare value'
              ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 17 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status,
         CASE WHEN o_orderkey % 30 = 0 THEN 'not-a-date'
              WHEN o_orderkey % 4 = 0 THEN yy || '-' || mm || '-' || dd
              WHEN o_orderkey % 4 = 1 THEN mm || '/' || dd || '/' || yy
              ELSE mm || '-' || dd || '-' || yy END AS order_date_txt,
         CASE WHEN o_orderkey % 20 = 0 THEN 1.5E0 END AS sparse_col,
         1 AS constant_col
  FROM base
)
SELECT * FROM messy
UNION ALL
SELECT * FROM messy WHERE order_id % 50 = 0
"""


def with_messy(body: str) -> str:
    """SQL whose ``messy_orders`` is the faulty orders table."""
    return f"WITH messy_orders AS ({MESSY_ORDERS})" + (", " + body[5:] if body.startswith("WITH ") else " " + body)
