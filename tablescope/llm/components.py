"""Connected components of a graph of 64-bit vertices by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``vertex, root`` of every vertex that has an edge to another; the root is the smallest vertex of its component.

    ``edges`` has columns ``a, b``; direction, repeats and loops do not matter. Each round moves every vertex's larger
    neighbours to its smallest neighbour and then its smaller ones, so the number of rounds grows with the logarithm of
    the component's size. Minima are combined before the shuffle, and joins are plain, so a hub can be split.
    """
    now = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
