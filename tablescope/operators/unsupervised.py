"""Standardising, principal components and k-means."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.errors import ValidationError
from tablescope.functions.columns import clean_number, numeric_cols, rows
from tablescope.plans import distance_sums
from tablescope.plans.copies import draw_rows
from tablescope.plans.quantiles import quantiles
from tablescope.plans.shipping import ship_by_value
from tablescope.plans.storage import materialize

_STARTS = 10
_RUNS_AT_ONCE = 4


def _moments(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[bool, float, float]]:
    """Per column whether values are missing, the mean and the population std, in one scan."""
    if not values:
        return {}
    aggregates = []
    for i, x in enumerate(values.values()):
        aggregates += [
            F.count_if(x.isNull()).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")
        ]
    row = df.agg(*aggregates).first()
    return {c: (row[f"n{i}"] > 0, row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(values)}


def standardise_exprs(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Per column: median fill, then (x - mean) / population std, with fitted literals.

    One scan serves all columns without gaps; medians are searched for the others only.
    """
    filled = {c: clean_number(c) for c in columns}
    moments = _moments(df, filled)
    gaps = [c for c in columns if moments[c][0]]
    medians = quantiles(df, gaps, [0.5])
    filled |= {c: F.coalesce(filled[c], F.lit(medians[c][0] or 0.0)) for c in gaps}
    moments |= _moments(df, {c: filled[c] for c in gaps})
    return {c: ((x - F.lit(moments[c][1])) / F.lit(moments[c][2])).alias(c) for c, x in filled.items()}


def standardise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The numeric columns, filled and scaled; other columns are dropped."""
    names = numeric_cols(df) if columns is None else columns
    return df.select(*standardise_exprs(df, names).values())


def _vectors(df: DataFrame, names: list[str]) -> DataFrame:
    """The table with ``features``, the standardised columns as one vector."""
    scaled = {f"_z{i}": e for i, e in enumerate(standardise_exprs(df, names).values())}
    assembler = VectorAssembler(inputCols=list(scaled), outputCol="features")
    return assembler.transform(df.withColumns(scaled))


@dataclass
class Components:
    scores: DataFrame
    explained: DataFrame
    loadings: DataFrame


def pca(df: DataFrame, k: int = 2, columns: list[str] | None = None) -> Components:
    """Principal components of the standardised columns.

    ``scores`` is the table with PC1..PCk; a component points to where its
    largest loading is positive.
    """
    names = numeric_cols(df) if columns is None else columns
    if len(names) < 2:
        raise ValidationError("Principal components need at least two numeric columns")
    if df.limit(3).count() < 3:
        raise ValidationError("Principal components need at least three rows")
    k = min(k, len(names))
    exprs = standardise_exprs(df, names)
    scaled = {f"_z{i}": exprs[c] for i, c in enumerate(names)}
    wide = df.withColumns(scaled)
    vectors = VectorAssembler(inputCols=list(scaled), outputCol="features").transform(wide).select("features")
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors)
    matrix = model.pc.toArray()
    loadings = []
    for j in range(k):
        vector = matrix[:, j]
        sign = 1.0 if vector[abs(vector).argmax()] >= 0 else -1.0
        loadings.append([float(v) * sign for v in vector])
    scores = wide.withColumns(
        {
            f"PC{j + 1}": sum((F.col(z) * F.lit(w) for z, w in zip(scaled, loadings[j])), F.lit(0.0))
            for j in range(k)
        }
    ).drop(*scaled)
    spark = df.sparkSession
    explained = [(f"PC{j + 1}", round(float(model.explainedVariance[j]), 4)) for j in range(k)]
    weights = [(c, f"PC{j + 1}", round(loadings[j][i], 3)) for i, c in enumerate(names) for j in range(k)]
    return Components(
        scores,
        rows(spark, explained, "component string, explained_ratio double"),
        rows(spark, weights, "column string, component string, loading double"),
    )


@dataclass
class Clusters:
    """``labelled`` is the table with ``cluster``; ``k`` the number of clusters asked for; Euclidean silhouette."""

    labelled: DataFrame
    k: int
    cost: float
    silhouette: float | None
    model: KMeansModel


def _check(df: DataFrame, names: list[str]) -> None:
    if len(names) < 2:
        raise ValidationError("Clustering needs at least two numeric columns")
    if df.limit(10).count() < 10:
        raise ValidationError("Clustering needs at least ten rows")


def _best_of(vectors: DataFrame, k: int, starts: int, seed: int) -> KMeansModel:
    """The run of lowest cost over distinct points with ``copies``; a few runs are submitted at a time, as each leaves executors idle between its jobs."""

    @inheritable_thread_target(vectors.sparkSession)
    def fit(start: int) -> KMeansModel:
        means = KMeans(
            k=k, seed=seed + start, featuresCol="features", predictionCol="cluster", maxIter=100, weightCol="copies"
        )
        return means.fit(vectors)

    with ThreadPoolExecutor(_RUNS_AT_ONCE) as pool:
        models = list(pool.map(fit, range(starts)))
    return min(models, key=lambda m: m.summary.trainingCost)


def silhouette(labelled: DataFrame, features: str = "features", label: str = "cluster") -> float | None:
    """Mean silhouette with squared Euclidean distances, whose cost is linear in the rows."""
    if labelled.select(label).distinct().limit(2).count() < 2:
        return None
    evaluator = ClusteringEvaluator(featuresCol=features, predictionCol=label, distanceMeasure="squaredEuclidean")
    value = evaluator.evaluate(labelled)
    return None if math.isnan(value) else round(value, 4)


#: Rows whose silhouettes are computed, each against all rows; smaller tables are computed whole.
_SILHOUETTE_ROWS = 2_000


def silhouette_interval(
    labelled: DataFrame, features: str = "features", label: str = "cluster", sample: int = _SILHOUETTE_ROWS
) -> DataFrame:
    """One row (silhouette, low, high, rows): the mean silhouette with Euclidean distances.

    The silhouettes of ``sample`` rows, drawn from each cluster by its size, are exact: their distances to all rows are
    added up in one scan.  Their weighted mean estimates that of all rows, with a 95 % interval; a table of at most
    ``sample`` rows is computed whole, and the interval is a point.  The only row of a cluster has 0.  Fewer than two
    clusters give NULL.
    """
    ship_by_value()
    vector = isinstance(labelled.schema[features].dataType, VectorUDT)
    points = labelled.select(
        (vector_to_array(features) if vector else F.col(features)).alias("x"), F.col(label).cast("long").alias("c")
    ).dropna()
    schema = "silhouette double, low double, high double, rows long"
    sizes = {r["c"]: r["n"] for r in points.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cluster
    if len(sizes) < 2:
        return rows(labelled.sparkSession, [(None, None, None, 0)], schema)
    total = sum(sizes.values())
    if total <= sample:
        drawn, wanted = points, sizes
    else:
        wanted = {c: min(n, max(2, math.ceil(sample * n / total))) for c, n in sizes.items()}
        rare = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, wanted[c])])
        share = min(1.0, max((w + 10 * math.sqrt(w) + 20) / sizes[c] for c, w in wanted.items()))
        # clusters differ in size: those that need less than the common share drop rows by the same hash
        first = draw_rows(points, SETTINGS.seed, share, place="spot")
        order = Window.partitionBy("c").orderBy("spot")
        drawn = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rare[F.col("c")]).select("x", "c")
    picked = drawn.collect()  # at most `sample` rows and two per cluster
    at, own = np.array([r["x"] for r in picked], float), np.array([r["c"] for r in picked])
    names = sorted(sizes)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(names), len(at)))
        for batch in batches:
            if not len(batch):
                continue
            x, c = np.stack(batch["x"].to_numpy()).astype(float), batch["c"].to_numpy()
            n = batch["n"].to_numpy().astype(float)
            for a in range(0, len(x), 256):
                square = np.zeros((len(x[a : a + 256]), len(at)))
                for j in range(x.shape[1]):
                    square += (x[a : a + 256, j, None] - at[None, :, j]) ** 2
                distance = np.sqrt(square)
                for k, name in enumerate(names):
                    mine = c[a : a + 256] == name
                    sums[k] += n[a : a + 256][mine] @ distance[mine]
        cluster, row = np.indices(sums.shape)
        yield pd.DataFrame({"cluster": cluster.ravel(), "row": row.ravel(), "s": sums.ravel()})

    counted = points.groupBy("x", "c").agg(F.count(F.lit(1)).alias("n"))  # equal points are as far from any other
    parts = counted.mapInPandas(add_up, "cluster int, row int, s double").groupBy("cluster", "row").agg(F.sum("s").alias("s"))
    sums = np.zeros((len(names), len(at)))
    for r in parts.collect():  # clusters times picked rows
        sums[r["cluster"], r["row"]] = r["s"]
    count = np.array([sizes[c] for c in names], float)
    mine = np.searchsorted(names, own)
    everyone = np.arange(len(at))
    inside = sums[mine, everyone] / np.maximum(count[mine] - 1, 1)
    means = sums / count[:, None]
    means[mine, everyone] = np.inf
    outside = means.min(0)
    value = np.where(count[mine] > 1, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300), 0.0)
    mean = variance = 0.0
    for k, name in enumerate(names):
        s, share = value[mine == k], sizes[name] / total
        if len(s):
            mean += share * s.mean()
            if 1 < len(s) < sizes[name]:
                variance += share**2 * s.var(ddof=1) / len(s) * (1 - len(s) / sizes[name])
    half = 1.96 * math.sqrt(variance)
    return rows(labelled.sparkSession, [(float(mean), float(mean - half), float(mean + half), len(at))], schema)


#: Points of a block; two blocks meet in one task.
_BLOCK_POINTS = 1 << 15
#: Points of a plane of which all pairs are met; beyond, only those that are near each other.
_MEETING_POINTS = 1 << 15
#: Coordinates beyond this, whose squares overflow, and more clusters than these are left to all pairs.
_LARGEST, _MOST_CLUSTERS = 1e150, 64


def silhouette_exact(
    labelled: DataFrame, features: str = "features", label: str = "cluster", block_points: int = _BLOCK_POINTS
) -> DataFrame:
    """One row (silhouette, rows): the mean silhouette with Euclidean distances over all rows.

    Equal points are one with a count.  All pairs of blocks of points meet, each pair in a group of its own, so memory is
    bounded by a block, and time grows with the square of the distinct points.  Of many points with one or two finite
    coordinates, only those near each other meet (``distance_sums``).
    """
    ship_by_value()
    spark = labelled.sparkSession
    vector = isinstance(labelled.schema[features].dataType, VectorUDT)
    points = labelled.select(
        (vector_to_array(features) if vector else F.col(features)).alias("x"), F.col(label).cast("long").alias("c")
    ).dropna()
    counted = materialize(points.groupBy("x", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    finite = F.coalesce(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < _LARGEST)), F.lit(False))
    facts = counted.groupBy("c").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("points"), F.bool_and(finite).alias("finite"),
        F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"),
    )
    facts = facts.collect()  # one row per cluster
    sizes = {r["c"]: (r["n"], r["points"]) for r in facts}
    schema = "silhouette double, rows long"
    if len(sizes) < 2:
        return rows(spark, [(None, 0)], schema)
    names = sorted(sizes)
    width = max(r["most"] for r in facts)
    flat = width in (1, 2) and min(r["least"] for r in facts) == width and all(r["finite"] for r in facts)
    distinct = sum(p for _, p in sizes.values())
    if flat and distinct > _MEETING_POINTS and len(names) <= _MOST_CLUSTERS:
        return rows(spark, [_silhouette_of_plane(counted, width, sizes)], schema)
    blocks = 1 + sum(p for _, p in sizes.values()) // block_points
    home = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    here = counted.select("id", "x", home.alias("a"), each.alias("b"))
    there = counted.select("x", "c", "n", each.alias("a"), home.alias("b"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "s": pd.Series([], dtype=object)})
        right = right.sort_values("c", kind="stable")
        x, y = (np.stack(f["x"].to_numpy()).astype(float) for f in (left, right))
        n = right["n"].to_numpy().astype(float)
        ends = np.searchsorted(right["c"].to_numpy(), names + [names[-1] + 1])
        sums = np.zeros((len(x), len(names)))
        for i in range(0, len(x), 64):
            for k in range(len(names)):
                for j in range(ends[k], ends[k + 1], 2048):
                    some = slice(j, min(j + 2048, ends[k + 1]))
                    square = np.zeros((len(x[i : i + 64]), len(n[some])))
                    for d in range(x.shape[1]):
                        step = x[i : i + 64, d, None] - y[None, some, d]
                        step *= step
                        square += step
                    sums[i : i + 64, k] += np.sqrt(square, out=square) @ n[some]
        return pd.DataFrame({"id": left["id"].to_numpy(), "s": list(sums)})

    found = here.groupBy("a", "b").cogroup(there.groupBy("a", "b")).applyInPandas(meet, "id long, s array<double>")
    # NaN comes back from pandas as NULL, and a mean with a NaN in it is none
    sums = found.groupBy("id").agg(*[F.sum(F.coalesce(F.get("s", F.lit(k)), F.lit(math.nan))).alias(f"s{k}") for k in range(len(names))])
    own = F.coalesce(*[F.when(F.col("c") == name, F.col(f"s{k}") / max(sizes[name][0] - 1, 1)) for k, name in enumerate(names)])
    others = [F.when(F.col("c") != name, F.col(f"s{k}") / sizes[name][0]) for k, name in enumerate(names)]
    other = F.least(*others) if len(others) > 1 else others[0]
    alone = F.col("c").isin([name for name in names if sizes[name][0] == 1])
    value = F.when(alone, 0.0).otherwise((F.col("out") - F.col("in")) / F.greatest("out", "in", F.lit(1e-300)))
    total = sum(n for n, _ in sizes.values())
    placed = counted.join(sums, "id").select("c", "n", own.alias("in"), other.alias("out"))
    return placed.agg((F.sum(F.col("n") * value) / total).alias("silhouette"), F.sum("n").alias("rows"))


def _silhouette_of_plane(counted: DataFrame, width: int, sizes: dict[int, tuple[int, int]]) -> tuple[float, int]:
    """(silhouette, rows) of points (x, c, n) with one or two coordinates."""
    names = sorted(sizes)
    count = np.array([sizes[c][0] for c in names], float)
    place = F.create_map(*[F.lit(v) for i, c in enumerate(names) for v in (c, i)])
    y = F.get("x", F.lit(1)).cast("double") if width > 1 else F.lit(0.0)
    points = counted.select(F.get("x", F.lit(0)).cast("double").alias("x"), y.alias("y"), place[F.col("c")].cast("int").alias("c"), "n")

    def finish(n: np.ndarray, c: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        everyone = np.arange(len(n))
        inside = sums[everyone, c] / np.maximum(count[c] - 1, 1)
        means = sums / count
        means[everyone, c] = np.inf
        outside = means.min(1)
        value = np.where(count[c] > 1, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300), 0.0)
        return pa.RecordBatch.from_arrays([pa.array([float(n @ value)]), pa.array([int(n.sum())], pa.int64())], ["value", "n"])

    distinct = sum(p for _, p in sizes.values())
    parts = distance_sums.sums_by_point(points, distinct, len(names), finish, "value double, n long")
    found = parts.agg(F.sum("value").alias("value"), F.sum("n").alias("n")).first()
    return found["value"] / sum(n for n, _ in sizes.values()), found["n"]


def _euclidean(labelled: DataFrame) -> float | None:
    value = silhouette_interval(labelled).first()["silhouette"]
    return None if value is None else round(value, 4)


def kmeans(
    df: DataFrame, k: int | None = None, columns: list[str] | None = None, starts: int = _STARTS
) -> Clusters:
    """Best of several seeded k-means runs on the standardised columns; ``k`` is chosen if not given."""
    names = numeric_cols(df) if columns is None else columns
    _check(df, names)
    vectors = _vectors(df, names)
    stored = materialize(vectors.select("features"))
    distinct = _counted(stored)
    if k is None:
        k = _auto_k(stored, distinct, starts)[0][0]
    model = _best_of(distinct, k, starts, SETTINGS.seed)
    quality = _euclidean(model.transform(stored))
    labelled = model.transform(vectors).drop("features", *[c for c in vectors.columns if c.startswith("_z")])
    return Clusters(labelled, k, model.summary.trainingCost, quality, model)


def _counted(stored: DataFrame) -> DataFrame:
    """Equal points as one row with ``copies``; every iteration of every run reads them."""
    return materialize(stored.groupBy("features").agg(F.count(F.lit(1)).cast("double").alias("copies")))


def _auto_k(stored: DataFrame, distinct: DataFrame, starts: int) -> list[tuple[int, float, float | None]]:
    top = min(SETTINGS.max_kmeans_k, stored.limit(SETTINGS.max_kmeans_k + 1).count() - 1)
    tried = []
    for k in range(2, top + 1):
        model = _best_of(distinct, k, starts, SETTINGS.seed)
        tried.append((k, model.summary.trainingCost, _euclidean(model.transform(stored))))
    return sorted(tried, key=lambda t: (-(t[2] if t[2] is not None else -2.0), t[0]))


def auto_k(df: DataFrame, columns: list[str] | None = None, starts: int = _STARTS) -> DataFrame:
    """(k, cost, silhouette, is_best) for k from 2 to 8, each the best of several runs."""
    names = numeric_cols(df) if columns is None else columns
    _check(df, names)
    stored = materialize(_vectors(df, names).select("features"))
    tried = _auto_k(stored, _counted(stored), starts)
    best = tried[0][0] if tried else None
    return rows(
        df.sparkSession,
        [(k, cost, quality, k == best) for k, cost, quality in sorted(tried)],
        "k int, cost double, silhouette double, is_best boolean",
    )
