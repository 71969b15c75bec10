"""Numbers for the copies of equal rows, so that draws depend on the rows and not on where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import col

#: Copies of a row that one task numbers at a time.
COPIES_AT_ONCE = 1 << 16
#: Drawn rows that are sent to every task at most.
_BROADCAST_ROWS = 1 << 20
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row; nulls are values of their own."""
    parts = []
    for f in df.schema.fields:
        # hashes pass over nulls, hence the flags
        value, kind = col(f.name), f.dataType
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, _NESTED):
            parts += [value, value.isNull(), F.transform(value, lambda v: v.isNull())]
        elif isinstance(kind, _NESTED):
            parts.append(F.to_json(F.struct(value), {"ignoreNullFields": "false"}))
        else:
            parts += [value, value.isNull()]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts[::-1])


def explode_copies(counted: DataFrame, copies: str, number: str, keys: list[str]) -> DataFrame:
    """One row per copy, numbered from 1 in ``number``; ``keys`` identify the rows of ``counted``.

    A row with very many copies is cut into parts that are spread over the tasks before they are numbered.
    """
    n = F.col(copies)
    few = counted.where(n <= COPIES_AT_ONCE).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    start = F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    many = counted.where(n > COPIES_AT_ONCE).withColumn("_start", start).repartition(*keys, "_start")
    numbers = F.sequence(F.col("_start") + 1, F.least(n, F.col("_start") + COPIES_AT_ONCE))
    return few.unionByName(many.withColumn(number, F.explode(numbers)).drop("_start")).drop(copies)


def with_draw(df: DataFrame, name: str, seed: int) -> DataFrame:
    """The rows with ``name``, a number in [0, 1) drawn by a hash of the row's values and the number of its copy.

    Equal rows are counted before they are shuffled.  Columns must be comparable.
    """
    slots = [f"v{i}" for i in range(len(df.columns))]
    counted = df.toDF(*slots).groupBy(*slots).agg(F.count(F.lit(1)).alias("copies"))
    one = explode_copies(counted, "copies", "copy", slots)
    # hashes pass over nulls, hence the flags
    parts = [p for s in slots for p in (F.col(s), F.col(s).isNull())]
    draw = F.pmod(F.xxhash64(F.lit(seed), "copy", *parts), F.lit(1 << 32)) / float(1 << 32)
    return one.select(*[F.col(s).alias(c) for s, c in zip(slots, df.columns, strict=True)], draw.alias(name))


def draw_rows(df: DataFrame, seed: int, share: float, limit: int | None = None, place: str | None = None) -> DataFrame:
    """About ``share`` of the rows, or of these the ``limit`` with the smallest draws.

    A copy of a row is drawn by a hash of the row's values and of its number among the copies, so that copies are drawn
    independently and the layout of the input does not matter.  To number copies, hashes and counts are shuffled, 16
    bytes a row at most; of the rows themselves only those with a drawn hash leave their task, equal ones as one row
    with a count.  ``place`` names an added column: a hash of the drawn row and copy.
    """
    # positions keep the names of this function apart from those of the table
    slots = [f"v{i}" for i in range(len(df.columns))]
    hashed = df.select(row_hashes(df)[0].alias("hash"), *[col(c).alias(s) for c, s in zip(df.columns, slots, strict=True)])
    copies = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    spot = F.xxhash64(F.lit(seed), "copy", "hash")
    draw = F.pmod(spot, F.lit(1 << 32)) / float(1 << 32)
    drawn = explode_copies(copies, "copies", "copy", ["hash"]).withColumn("draw", draw).where(F.col("draw") < share)
    if limit is not None:
        drawn = drawn.orderBy("draw", "hash", "copy").limit(limit)
    wanted = drawn.groupBy("hash").agg(F.collect_list("copy").alias("wanted"))
    if limit is not None and limit <= _BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # `limit` rows at most
    held = hashed.join(wanted, "hash").groupBy("hash", *slots)
    held = held.agg(F.count(F.lit(1)).alias("copies"), F.first("wanted").alias("wanted"))
    # different rows of one hash, if there are any, share its numbers in the order of their values
    running = Window.partitionBy("hash").orderBy(*slots).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum("copies").over(running)
    mine = F.filter("wanted", lambda k: (k <= F.col("last")) & (k > F.col("last") - F.col("copies")))
    one = held.withColumn("last", last).select("hash", F.explode(mine).alias("copy"), *slots)
    added = [spot.alias(place)] if place else []
    return one.select(*[F.col(s).alias(c) for s, c in zip(slots, df.columns, strict=True)], *added)
