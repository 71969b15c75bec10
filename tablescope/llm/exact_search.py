"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments, coarse to fine. Means and deviations of a segment of length L bound the distance of two
vectors from below by L * ((difference of means)^2 + (difference of deviations)^2), and with the norms that is a bound
of the inner product from above: L * (product of means + product of deviations). A candidate whose bound is below the
k-th best score so far is discarded at the coarsest level that shows it; survivors are scored exactly.

Queries and candidates are cut into blocks of bounded size: vectors whose segment means have the same signs and whose
spread is alike share one. The ranges of the statistics in two blocks bound all their inner products. Each block of
queries first meets the block of candidates with the highest bound, which gives its queries a k-th best score; only
blocks whose bound reaches the smallest of these are shuffled to it at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import materialize, ship_by_value

K = 5
SCALE = 256
SEGMENTS = (1, 4, 16)
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
#: Queries and candidates whose bounds are in memory at a time.
_TILE = (256, 2048)
#: Sums of products below this are exact in a double.
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, x``: every component as floor(scale * component). Vectors that are null or hold a null or
    non-finite component are left out, and rows without ``vec_id``."""
    x = F.transform(column, lambda c: c.cast("double"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & whole)
        .select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("x"))
    )


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, each times the root of the length: products add up to the bound."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    columns = []
    for part in parts:
        mean = part.mean(axis=1)
        deviation = np.sqrt(np.maximum(((part - mean[:, None]) ** 2).sum(axis=1), 0))
        columns += [mean * np.sqrt(part.shape[1]), deviation]
    return np.stack(columns, axis=1)


def _scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray, exact: bool) -> np.ndarray:
    if not exact:  # beyond doubles: Python's integers, kept within 64 bits
        whole = [sum(a * b for a, b in zip(q[r].tolist(), x[c].tolist(), strict=True)) for r, c in zip(rows, columns, strict=True)]
        return np.array([max(min(v, (1 << 63) - 1), -(1 << 63)) for v in whole], np.int64)
    out = np.empty(len(rows), np.int64)
    step = 1 << 16
    for k in range(0, len(rows), step):
        out[k : k + step] = np.einsum("ij,ij->i", q[rows[k : k + step]], x[columns[k : k + step]]).astype(np.int64)
    return out


def best_of_block(
    query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, k: int = K
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, candidate number and score of each query's best ``k`` in a block; ties go to smaller ``vec_id``."""
    order = np.argsort(vec_id, kind="stable")
    vec_id, x = vec_id[order], x[order]
    n, dim = len(query_id), q.shape[1]
    low = np.iinfo(np.int64).min
    top = np.full((n, k), low, np.int64)  # scores, descending; with equal scores the smaller number of the candidate first
    who = np.full((n, k), -1, np.int64)
    if not n or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    exact = dim == 0 or float(np.abs(fq).max(initial=0)) * float(np.abs(fx).max(initial=0)) * dim < _EXACT
    levels = [(_statistics(fq, s), _statistics(fx, s)) for s in SEGMENTS] if exact and dim else []
    norm = np.sqrt((fq**2).sum(1))[:, None], np.sqrt((fx**2).sum(1))[None, :]
    for a in range(0, n, _TILE[0]):
        rows = slice(a, min(a + _TILE[0], n))
        # the first candidates are scored in full, so that there is a k-th best to compare with
        steps = [(0, min(64, len(x))), *((b, min(b + _TILE[1], len(x))) for b in range(64, len(x), _TILE[1]))]
        for b, c in steps:
            alive = query_id[rows, None] != vec_id[None, b:c]
            slack = 1e-9 * norm[0][rows] * norm[1][:, b:c] + 1e-6
            if b:
                for sq, sx in levels:
                    bound = sq[rows] @ sx[b:c].T
                    alive &= bound + slack >= top[rows, -1:]
                    if not alive.any():
                        break
            r, col = np.nonzero(alive)
            if not len(r):
                continue
            got = _scores(fq if exact else q, fx if exact else x, r + a, col + b, exact)
            keep = got > top[r + a, -1]  # candidates come by ascending id: an equal score later is never better
            keep |= who[r + a, -1] < 0
            r, col, got = r[keep], col[keep], got[keep]
            # merge with what the queries have: by query, score descending, number ascending
            have_r, have_c = np.nonzero(who[rows] >= 0)
            r = np.concatenate([have_r, r])
            number = np.concatenate([who[rows][have_r, have_c], col + b])
            score = np.concatenate([top[rows][have_r, have_c], got])
            by = np.lexsort((number, -score.astype(np.float64) if exact else ~score, r))
            r, number, score = r[by], number[by], score[by]
            first = np.searchsorted(r, r)
            place = np.arange(len(r)) - first
            keep = place < k
            top[rows], who[rows] = low, -1
            top[r[keep] + a, place[keep]] = score[keep]
            who[r[keep] + a, place[keep]] = number[keep]
    r, place = np.nonzero(who >= 0)
    return r, order[who[r, place]], top[r, place]


#: Segments whose statistics place a vector in a block and bound blocks.
_PLACING = 4
#: Blocks of candidates whose ranges are sent to every task; with more vectors blocks grow.
_MOST_BLOCKS = 100_000


def _placed(vectors: DataFrame, block: int) -> DataFrame:
    """``vec_id, dim, x, block, low, high``: the vectors with their block, and for each statistic its range there.

    A block holds vectors of one dimension. Its number is drawn from the signs of the segment means, the deviation, and
    a hash, so that equal vectors are spread as well; blocks hold about ``block`` rows, however many share a sign.
    """
    kind = "vec_id long, dim int, x array<long>, signs int, spread double, low array<double>, high array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim).astype(float)
                if dim:
                    stats = _statistics(x, _PLACING)
                    signs = (stats[:, 0::2] > 0) @ (1 << np.arange(stats.shape[1] // 2))
                    spread = np.sqrt((stats[:, 1::2] ** 2).sum(1))
                else:
                    stats, signs, spread = np.zeros((part.num_rows, 2)), np.zeros(part.num_rows, int), np.zeros(part.num_rows)
                lists = pa.array(list(stats), pa.list_(pa.float64()))
                columns = [*part.columns, pa.array(signs.astype(np.int32)), pa.array(spread), lists, lists]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "x", "signs", "spread", "low", "high"])

    rows = materialize(vectors.select("vec_id", "dim", "x").mapInArrow(run, kind))
    # cuts of the spread within each dimension and pattern of signs: few rows, as there are few patterns
    sizes = rows.groupBy("dim", "signs").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("spread", [k / 64 for k in range(1, 64)], 1000).alias("cuts")
    )
    offset, table = 0, []
    for r in sizes.orderBy("dim", "signs").collect():
        parts = max(1, -(-r["n"] // block))
        cuts = sorted(set(r["cuts"][:: max(1, 64 // parts)])) if parts > 1 else []
        spare = -(-parts // (len(cuts) + 1))  # equal spreads, and more blocks than cuts, are dealt by a hash
        table.append((r["dim"], r["signs"], cuts, spare, offset))
        offset += (len(cuts) + 1) * spare
    places = F.broadcast(  # one row per dimension and pattern
        rows.sparkSession.createDataFrame(table, "dim int, signs int, cuts array<double>, spare int, offset int")
    )
    range_ = F.size(F.filter("cuts", lambda c: c < F.col("spread")))
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("spare")).cast("int")
    return rows.join(places, ["dim", "signs"]).select(
        "vec_id", "dim", "x", (F.col("offset") + range_ * F.col("spare") + dealt).alias("block"), "low", "high"
    )


def _ranges(placed: DataFrame) -> DataFrame:
    """``block, dim, rows, low, high`` of every block: the least and greatest value of each statistic."""
    each = placed.select("block", "dim", F.posexplode(F.arrays_zip("low", "high")).alias("at", "s"))
    found = each.groupBy("block", "dim", "at").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))
    by_block = found.groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("s"))
    return by_block.select("block", "dim", F.col("s.low").alias("low"), F.col("s.high").alias("high"))


def _block_bounds(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of a block's vectors with those of each other block."""
    corners = np.stack([low * lows, low * highs, high * lows, high * highs])
    # rounding of the statistics: a little more than the bound
    bound = corners.max(0).sum(1)
    return bound + 1e-6 + 1e-9 * (np.maximum(np.abs(low), np.abs(high)) * np.maximum(np.abs(lows), np.abs(highs))).sum(1)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _meet(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of each query in each of its block's partners.

    ``pairs``: ``query_block, block``. Only blocks with a partner are shuffled, once to each.
    """

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _FOUND.empty_table()
        dim = a.column("dim")[0].as_py()
        matrix = [t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim) for t in (a, b)]
        query_id, vec_id = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        r, c, score = best_of_block(query_id, matrix[0], vec_id, matrix[1], k)
        return pa.Table.from_arrays([pa.array(query_id[r]), pa.array(vec_id[c]), pa.array(score)], schema=_FOUND)

    keys = ["query_block", "block"]
    left = queries.select("vec_id", "dim", "x", F.col("block").alias("query_block")).join(pairs, "query_block")
    right = vectors.select("vec_id", "dim", "x", "block").join(pairs, "block")
    names = ["vec_id", "dim", "x", *keys]
    return (
        left.select(names).groupBy(*keys).cogroup(right.select(names).groupBy(*keys))
        .applyInArrow(pair, "query_id long, vec_id long, score long")
    )


def block_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query_block, block, bound`` for all pairs of blocks of one dimension.

    The candidates' ranges, at most ``_MOST_BLOCKS`` rows, go to the tasks that hold the queries' ranges.
    """
    ours = _ranges(vectors).orderBy("block").toPandas()
    dims = ours["dim"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, low, high in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "low", "high")), strict=True):
                same = np.flatnonzero(dims == dim)
                if not len(same):
                    continue
                lows, highs = (np.stack(ours[c].to_numpy()[same]) for c in ("low", "high"))
                bound = _block_bounds(np.array(low), np.array(high), lows, highs)
                number = ours["block"].to_numpy()[same].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(same), block, np.int32)), pa.array(number), pa.array(bound)],
                    ["query_block", "block", "bound"],
                )

    return _ranges(queries).mapInArrow(run, "query_block int, block int, bound double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` best candidates by integer inner product.

    Both tables have ``vec_id, dim, x`` (see ``integer_vectors``). A query is compared with vectors of its own
    dimension only, and never with rows of its own ``vec_id``. Queries that repeat a ``vec_id`` count once (the smallest
    vector); repeated candidates count as often as they come. With fewer than ``k`` candidates all are returned.
    """
    ship_by_value()
    queries = queries.groupBy("vec_id", "dim").agg(F.min("x").alias("x"))
    right = materialize(_placed(vectors, max(CANDIDATE_BLOCK, -(-vectors.count() // _MOST_BLOCKS))))
    left = materialize(_placed(queries, QUERY_BLOCK))
    bounds = materialize(block_pairs(left, right))
    # the most promising block first; a pair is settled there or dropped by its bound
    first = bounds.groupBy("query_block").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    first = materialize(first)
    found = materialize(_meet(left, right, first, k))
    place = F.row_number().over(Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "vec_id"))
    # a query without k candidates yet has no least score, and its block meets all others
    held = found.join(left.select(F.col("vec_id").alias("query_id"), "dim").distinct(), "query_id")
    last = held.withColumn("place", place).where(F.col("place") == k).select("query_id", "dim", F.col("score").alias("kth"))
    asked = left.select(F.col("vec_id").alias("query_id"), "dim", F.col("block").alias("query_block"))
    least = asked.join(last, ["query_id", "dim"], "left").groupBy("query_block").agg(
        F.min(F.coalesce("kth", F.lit(-(1 << 63)))).alias("least")
    )
    rest = bounds.join(first, ["query_block", "block"], "left_anti").join(least, "query_block")
    rest = materialize(rest.where(F.col("bound") >= F.col("least")).select("query_block", "block"))
    everything = found.unionByName(_meet(left, right, rest, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        everything.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def search(vectors: DataFrame, column: str = "embedding", every: int = 50, k: int = K) -> DataFrame:
    """``top_k`` of all rows whose ``vec_id`` is divisible by ``every``, against all rows."""
    whole = materialize(integer_vectors(vectors, column))
    return top_k(whole, whole.where(F.col("vec_id") % every == 0), k)
