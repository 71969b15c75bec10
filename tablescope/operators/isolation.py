"""Isolation forest and combined anomaly detection.

Liu, Ting and Zhou (2008): random trees on subsamples of at most 256 rows,
scored by the mean path length.  Subsamples are drawn by hashing, trees are
grown one group per tree, and the finished forest, whose size depends on the
number of trees only, scores all rows in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.functions.columns import numeric_cols
from tablescope.operators.outliers import robust_scales, spikes_column, spikes_text
from tablescope.operators.unsupervised import standardise_exprs
from tablescope.plans.copies import draw_rows
from tablescope.plans.quantiles import quantiles
from tablescope.plans.shipping import ship_by_value
from tablescope.plans.storage import materialize

TREES = 100
SUBSAMPLE = 256
FOREST_REASON = "multivariate outlier"
SPIKE_REASON = "univariate spike: "
TOO_SMALL = "too few rows for anomaly detection"


def _average_path(size):
    """Expected path length of an unsuccessful search among ``size`` points."""
    size = np.asarray(size, dtype=float)
    safe = np.maximum(size, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(size > 2, long, np.where(size == 2, 1.0, 0.0))


def _grow(points: np.ndarray, seed: int) -> list[list]:
    """Nodes [feature, threshold, left child, path length] of one tree.

    The right child follows the left one.  A leaf is its own left child behind
    an infinite threshold, so that walking on from it changes nothing.
    """
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list] = [[]]
    todo = [(0, points, 0)]
    while todo:
        place, block, depth = todo.pop()
        splittable = np.flatnonzero(np.ptp(block, axis=0) > 0) if len(block) > 1 else []
        if depth >= limit or len(splittable) == 0:
            nodes[place] = [0, np.inf, place, depth + float(_average_path(len(block)))]
            continue
        feature = int(rng.choice(splittable))
        values = block[:, feature]
        threshold = float(rng.uniform(values.min(), values.max()))
        nodes[place] = [feature, threshold, len(nodes), 0.0]
        for side in (block[values <= threshold], block[values > threshold]):
            todo.append((len(nodes), side, depth + 1))
            nodes.append([])
    return nodes


def _subsamples(points: DataFrame, n: int, seed: int, trees: int) -> DataFrame:
    """(tree, features, _draw): for each tree about 1.5 x 256 rows, drawn by hashes of the row and its copy's number.

    Copies of a row are drawn independently, so no group grows with the data, and the layout of the table does not
    matter. A first test on one hash spares most rows of a large table the per-tree hashes.
    """
    per_tree = min(1.0, 1.5 * SUBSAMPLE / n)
    first = min(1.0, trees * per_tree)
    scale = float(1 << 32)

    def draw(*salt):
        return F.pmod(F.xxhash64("_place", *salt), F.lit(1 << 32))

    chosen = draw_rows(points.select("features"), seed, first, place="_place")
    ids = F.array(*[F.lit(t) for t in range(trees)])
    wins = F.filter(ids, lambda t: draw(F.lit(seed + 1), t) < per_tree / first * scale)
    joined = chosen.select("features", "_place", F.explode(wins).alias("tree"))
    return joined.select("tree", "features", draw(F.lit(seed + 2), F.col("tree")).alias("_draw"))


def fit_forest(points: DataFrame, n: int, seed: int | None = None, trees: int = TREES) -> pd.DataFrame:
    """(tree, node, feature, threshold, left, path) of the trees grown on a ``features`` array of n rows."""
    ship_by_value()
    seed = SETTINGS.seed if seed is None else seed

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        kept = frame.sort_values("_draw").head(SUBSAMPLE)
        tree = int(frame["tree"].iloc[0])
        nodes = _grow(np.array(kept["features"].tolist(), dtype=float), seed + tree)
        table = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "path"])
        table.insert(0, "node", range(len(nodes)))
        table.insert(0, "tree", tree)
        return table

    grown = (
        _subsamples(points, n, seed, trees)
        .groupBy("tree")
        .applyInPandas(grow, "tree int, node int, feature int, threshold double, left int, path double")
        .toPandas()  # at most trees x 511 nodes
    )
    return grown.sort_values(["tree", "node"], ignore_index=True)


def score_forest(df: DataFrame, features: list[Column], forest: pd.DataFrame, n: int, output: str) -> DataFrame:
    """Add ``output``: minus 2 to the power of minus the normalised mean path; low means isolated."""
    ship_by_value()
    roots = np.flatnonzero(forest["node"].to_numpy() == 0).astype("int32")
    start = roots[np.searchsorted(roots, np.arange(len(forest)), side="right") - 1]
    feature, threshold = forest["feature"].to_numpy(dtype="int32"), forest["threshold"].to_numpy()
    left, path = forest["left"].to_numpy(dtype="int32") + start, forest["path"].to_numpy()
    levels = int(np.ceil(np.log2(max(min(SUBSAMPLE, n), 2))))
    normal = float(_average_path(min(SUBSAMPLE, n))) or 1.0

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        means = np.empty(len(x))
        for first in range(0, len(x), 200):  # blocks that fit the processor cache
            block = x[first : first + 200]
            cells, row = block.ravel(), (np.arange(len(block), dtype="int32") * x.shape[1])[:, None]
            at = np.tile(roots, (len(block), 1))
            for _ in range(levels):
                at = left.take(at) + (cells.take(feature.take(at) + row) > threshold.take(at))
            means[first : first + 200] = path.take(at).mean(axis=1)
        return pd.Series(-(2.0 ** (-means / normal)))

    return df.withColumn(output, isolation(*features))


def isolation_forest(
    df: DataFrame, columns: list[str] | None = None, contamination: float | None = None, seed: int | None = None
) -> DataFrame:
    """The table with ``is_isolated`` and ``isolation_score`` (above 0 means anomalous).

    Rows are scored once and stored with their scores, since the cut-off is an exact quantile of all scores.
    """
    names = numeric_cols(df) if columns is None else columns
    share = SETTINGS.contamination if contamination is None else contamination
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n == 0 or not names:
        return df.withColumn("is_isolated", F.lit(False)).withColumn("isolation_score", F.lit(0.0))
    features = list(standardise_exprs(df, names).values())
    forest = fit_forest(df.select(F.array(*features).alias("features")), n, seed)
    scored = materialize(score_forest(df, features, forest, n, "_raw"))
    cut = quantiles(scored, ["_raw"], [share], {"_raw": n})["_raw"][0]
    return (
        scored.withColumn("is_isolated", F.col("_raw") < F.lit(cut))
        .withColumn("isolation_score", F.round(F.lit(cut) - F.col("_raw"), 4))
        .drop("_raw")
    )


def detect_anomalies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table with ``is_anomaly``, ``anomaly_score`` and ``anomaly_reason``.

    A row is anomalous if the forest isolates it or one of its cells is far
    from the column's median.  Tables that are too small are returned unflagged.
    """
    names = numeric_cols(df) if columns is None else columns
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not names or n < SETTINGS.min_rows_anomaly:
        return (
            df.withColumn("is_anomaly", F.lit(False))
            .withColumn("anomaly_score", F.lit(0.0))
            .withColumn("anomaly_reason", F.lit(TOO_SMALL))
        )
    scales = robust_scales(df, names)
    scored = isolation_forest(df, names).withColumn("spikes", spikes_column(scales))
    spiky = F.size("spikes") > 0
    reasons = F.array_compact(
        F.array(
            F.when(F.col("is_isolated"), F.lit(FOREST_REASON)),
            F.when(spiky, F.concat(F.lit(SPIKE_REASON), spikes_text())),
        )
    )
    return (
        scored.withColumn("is_anomaly", F.col("is_isolated") | spiky)
        .withColumn("anomaly_reason", F.array_join(reasons, "; "))
        .withColumnRenamed("isolation_score", "anomaly_score")
        .drop("spikes", "is_isolated")
    )
