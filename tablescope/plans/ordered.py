"""Windows over an explicit row order that do not depend on group sizes.

A plain ``Window.partitionBy(keys).orderBy(...)`` puts each group into one
task.  When the largest group is known to be small that is the best plan.
Otherwise the rows are sorted across the cluster, numbered, and cut into even
blocks; the last ``lookback`` rows of a block are copied into the next one so
that each frame is complete inside its block.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import analysable_cols, col
from tablescope.plans.storage import materialize

POSITION = "_pos"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("n")).first()["n"] or 0


def tie_break(df: DataFrame) -> Column:
    """A hash of the row, which orders rows that are equal in all columns of the order."""
    return F.xxhash64(*[col(c) for c in analysable_cols(df)])


def with_positions(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Add ``_pos``, the 0-based position of each row in the order of ``order_by``.

    A range sort spreads the rows evenly (a hash of the row separates equal
    keys), rows are numbered per partition, and the written table fixes that
    numbering before partition sizes are turned into offsets.
    """
    numbered = df.orderBy(*[col(c) for c in order_by], tie_break(df)).withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(numbered).withColumn("_part", F.shiftright("_id", 33))
    sizes = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "_part long, _start long"
    )
    within = F.col("_id").bitwiseAND((1 << 33) - 1)
    return (
        stored.join(F.broadcast(offsets), "_part")  # one row per sort partition
        .withColumn(POSITION, F.col("_start") + within)
        .drop("_id", "_part", "_start")
    )


def over_order(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str],
    lookback: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    hot_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``lookback`` rows back.

    ``columns`` receives the ordered window and returns the new columns by name.
    """
    limit = hot_group_rows or SETTINGS.hot_group_rows
    keys = [col(k) for k in partition_by]
    if largest_group(df, partition_by) <= limit:
        # rows that are equal in `order_by` come in the order of the same hash as below
        spec = Window.partitionBy(*keys).orderBy(*[col(c) for c in order_by], tie_break(df))
        return df.withColumns(columns(spec))
    block = max(block_rows or SETTINGS.split_block_rows, lookback + 1)
    home = F.floor(F.col(POSITION) / block)
    placed = with_positions(df, [*partition_by, *order_by]).withColumn("_home", home)
    tail = F.col(POSITION) % block >= block - lookback
    copied = placed.withColumn(
        "_block",
        F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))),
    )
    spec = Window.partitionBy("_block", *keys).orderBy(POSITION)
    return (
        copied.withColumns(columns(spec))
        .filter(F.col("_block") == F.col("_home"))
        .drop("_block", "_home", POSITION)
    )
