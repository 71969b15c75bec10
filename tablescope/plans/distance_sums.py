"""Sums of Euclidean distances from each point of a plane to all points of each class, without meeting all pairs.

A tree of boxes is cut at medians of drawn points; the draw decides only where boxes end.  All points are then placed in
the leaves.  Points of boxes that are near each other meet one by one.  For boxes at least one side apart, distances are a
smooth function of both points, so a box acts through its weights at 16 Chebyshev nodes per axis (one if it has no
extent there) and is felt at such nodes; the relative error of such a distance is below 1e-10.  All points count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.plans.shipping import ship_by_value
from tablescope.plans.storage import materialize

#: Nodes per axis, drawn points per leaf, leaves whose points are one group, distances that are held at a time.
_NODES, _DRAWN, _LEAVES_AT_ONCE, _AT_ONCE = 16, 50, 16, 1 << 17
#: Points of a leaf, and sums that the nodes of all leaves hold at most.
LEAF_POINTS, _HELD = 1024, 1 << 23
_TASKS = 64


def leaves_for(points: int, classes: int) -> int:
    return min(points // LEAF_POINTS, _HELD // (_NODES**2 * classes))


def _basis(u: np.ndarray, nodes: int) -> np.ndarray:
    """The values at ``u`` (in [-1, 1]) of the polynomials that are 1 at one Chebyshev node and 0 at the others."""
    if nodes == 1:
        return np.ones((len(u), 1))
    rising = np.empty((nodes, len(u)))
    rising[0], rising[1] = 1.0, u
    for k in range(2, nodes):
        rising[k] = 2 * u * rising[k - 1] - rising[k - 2]
    k = np.arange(nodes)
    at = np.cos(np.outer(k, (2 * k + 1) * np.pi / (2 * nodes))) * np.where(k == 0, 1.0, 2.0)[:, None] / nodes
    return rising.T @ at


def _nodes(half: float) -> np.ndarray:
    """Nodes of an axis, from the centre of the box."""
    if half == 0:
        return np.zeros(1)
    return half * np.cos((2 * np.arange(_NODES) + 1) * np.pi / (2 * _NODES))


def _weights(x: np.ndarray, centre: float, half: float) -> np.ndarray:
    return _basis(np.clip((x - centre) / half, -1, 1) if half else x, _NODES if half else 1)


class Cuts:
    """A tree over the plane; the right child follows the left one."""

    def __init__(self, drawn: np.ndarray, leaves: int):
        axis, threshold, left = [0], [math.inf], [0]
        most = max(1, len(drawn) // max(leaves, 1))
        open_ = [(0, drawn)]
        while open_:
            at, some = open_.pop()
            extent = np.ptp(some, axis=0) if len(some) else np.zeros(2)
            if len(some) <= most or not extent.max() > 0:
                continue
            by = int(extent.argmax())
            v = some[:, by]
            cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if cut == v.max():
                cut = v[v < cut].max()
            axis[at], threshold[at], left[at] = by, cut, len(left)
            lower = v <= cut
            for part in (some[lower], some[~lower]):
                open_.append((len(left), part))
                axis.append(0), threshold.append(math.inf), left.append(len(left))
        self.axis, self.threshold, self.left = np.array(axis), np.array(threshold), np.array(left)
        # leaves are numbered from left to right, so that neighbours have close numbers
        self.leaf = np.full(len(left), -1)
        number, stack = 0, [0]
        while stack:
            at = stack.pop()
            if left[at] == at:
                self.leaf[at], number = number, number + 1
            else:
                stack += [left[at] + 1, left[at]]
        self.leaves = number

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at, walking = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(walking):
            here = at[walking]
            moving = self.left[here] != here
            walking, here = walking[moving], here[moving]
            at[walking] = self.left[here] + (x[walking, self.axis[here]] > self.threshold[here])
        return self.leaf[at]


def _columns(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group[n].to_numpy() for n in names]


class Boxes:
    """All boxes of the tree with their weights and sums at nodes, by box an array (class, node of x, node of y)."""

    def __init__(self, cuts: Cuts, found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], classes: int):
        """``found``: by leaf that has points the least and greatest coordinates, and the weights."""
        self.left, n = cuts.left, len(cuts.left)
        self.low, self.high = np.full((n, 2), math.inf), np.full((n, 2), -math.inf)
        self.is_leaf = self.left == np.arange(n)
        weights: list = [None] * n
        for b in np.flatnonzero(self.is_leaf):
            if cuts.leaf[b] in found:
                self.low[b], self.high[b], weights[b] = found[cuts.leaf[b]]
        for b in range(n - 1, -1, -1):  # children have greater numbers
            if not self.is_leaf[b]:
                for child in (self.left[b], self.left[b] + 1):
                    self.low[b], self.high[b] = np.minimum(self.low[b], self.low[child]), np.maximum(self.high[b], self.high[child])
        self.used = self.low[:, 0] <= self.high[:, 0]
        low, high = np.where(self.used[:, None], self.low, 0.0), np.where(self.used[:, None], self.high, 0.0)
        self.centre = low + (high - low) / 2
        self.half = np.maximum(high - self.centre, self.centre - low)
        self.carry: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in range(n - 1, -1, -1):
            if self.is_leaf[b] or not self.used[b]:
                continue
            total = 0.0
            for child in (self.left[b], self.left[b] + 1):
                if self.used[child]:
                    self.carry[child] = x, y = tuple(self._to_parent(child, b, a) for a in (0, 1))
                    total = total + x.T @ weights[child] @ y
            weights[b] = total
        self.weights = weights

    def _to_parent(self, child: int, parent: int, axis: int) -> np.ndarray:
        at = self.centre[child, axis] - self.centre[parent, axis] + _nodes(self.half[child, axis])
        return _weights(at, 0.0, self.half[parent, axis])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(target, source) boxes that are far from each other, and leaves that are near each other."""
        side = self.half.max(1)
        here, there = np.zeros(1, np.int64), np.zeros(1, np.int64)
        far, near = [], []
        while len(here):
            gap = np.maximum(0.0, np.abs(self.centre[here] - self.centre[there]) - self.half[here] - self.half[there])
            apart = np.hypot(gap[:, 0], gap[:, 1]) >= 2 * np.maximum(side[here], side[there])
            far.append(np.stack([here[apart], there[apart]]))
            here, there = here[~apart], there[~apart]
            ends = self.is_leaf[here] & self.is_leaf[there]
            near.append(np.stack([here[ends], there[ends]]))
            here, there = here[~ends], there[~ends]
            first = ~self.is_leaf[here] & (self.is_leaf[there] | (side[here] >= side[there]))
            a, b = self.left[here[first]], self.left[there[~first]]
            here, there = (
                np.concatenate([a, a + 1, here[~first], here[~first]]), np.concatenate([there[first], there[first], b, b + 1])
            )
            used = self.used[here] & self.used[there]
            here, there = here[used], there[used]
        return np.concatenate(far, 1), np.concatenate(near, 1)

    def hand_down(self, sums: list[np.ndarray]) -> None:
        """Add what a box feels to its children."""
        for b in np.flatnonzero(~self.is_leaf & self.used):  # parents have lesser numbers
            for child in (self.left[b], self.left[b] + 1):
                if self.used[child]:
                    x, y = self.carry[child]
                    sums[child] += x @ sums[b] @ y.T


def sums_by_point(points: DataFrame, total: int, classes: int, finish, schema: str) -> DataFrame:
    """``finish(n, c, sums)`` of all points, group by group; its record batches are the rows of the result.

    ``points`` is a stored table (x, y, c, n): coordinates, class (0, 1, ...) and count of distinct points, ``total`` of them;
    ``sums`` has for each point and class the sum of the distances to all points of the class.
    """
    ship_by_value()
    spark = points.sparkSession
    leaves = leaves_for(total, classes)
    share = min(1.0, _DRAWN * leaves / total)
    draw = F.pmod(F.xxhash64(F.lit(SETTINGS.seed), "x", "y", "c"), F.lit(1 << 32)) / float(1 << 32)
    drawn = points.where(draw < share).select("x", "y").toArrow()
    cuts = Cuts(np.stack(_columns(drawn, "x", "y"), 1), leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = cuts.place(np.stack([batch["x"].to_numpy(), batch["y"].to_numpy()], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    placed = materialize(points.select("x", "y", "c", "n").mapInArrow(place, "x double, y double, c int, n long, leaf int"))
    at = F.floor(F.col("leaf") / _LEAVES_AT_ONCE).cast("int").alias("group")

    def weigh(group: pa.Table) -> pa.Table:
        x, y, c, n, leaf = _columns(group, "x", "y", "c", "n", "leaf")
        found = []
        for one in np.unique(leaf):
            mine = np.flatnonzero(leaf == one)
            xy = np.stack([x[mine], y[mine]], 1)
            low, high = xy.min(0), xy.max(0)
            centre = low + (high - low) / 2
            half = np.maximum(high - centre, centre - low)
            ax, ay = (_weights(xy[:, a] - centre[a], 0.0, half[a]) for a in (0, 1))
            sums = [(ax[k] * n[mine][k, None]).T @ ay[k] for k in (c[mine] == j for j in range(classes))]
            found.append((int(one), [*low, *high], np.stack(sums).ravel()))
        kinds = pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())
        return pa.table([pa.array(v, k) for v, k in zip(zip(*found), kinds)], ["leaf", "box", "weights"])

    weighed = placed.groupBy(at).applyInArrow(weigh, "leaf int, box array<double>, weights array<double>").toArrow()
    found = {}
    for leaf, box, weights in zip(*(weighed[c].combine_chunks() for c in ("leaf", "box", "weights"))):
        low, high = np.array(box.as_py()).reshape(2, 2)
        shape = [_NODES if high[a] > low[a] else 1 for a in (0, 1)]
        found[leaf.as_py()] = low, high, weights.values.to_numpy().reshape(classes, *shape)
    boxes = Boxes(cuts, found, classes)
    far, near = boxes.pairs()
    sums = _felt(spark, boxes, far, classes)
    boxes.hand_down(sums)

    box_of = np.full(cuts.leaves, -1)
    box_of[cuts.leaf[boxes.is_leaf]] = np.flatnonzero(boxes.is_leaf)
    near = cuts.leaf[near][:, np.lexsort((near[1], near[0]))]
    near = near[:, np.argsort(near[0], kind="stable")]
    starts = np.searchsorted(near[0], np.arange(cuts.leaves + 1))
    leaf_sums = {int(leaf): sums[box_of[leaf]] for leaf in found}
    held = spark.sparkContext.broadcast((leaf_sums, boxes.centre[box_of], boxes.half[box_of], near[1], starts))
    wanted = pd.DataFrame({"leaf": near[1], "group": near[0] // _LEAVES_AT_ONCE}).drop_duplicates()
    sent = placed.join(F.broadcast(spark.createDataFrame(wanted, "leaf int, group int")), "leaf")

    def meet(key, group):  # without hints, from which Spark would guess another kind
        leaf_sums, centre, half, sources, starts = held.value
        x, y, c, n, leaf = _columns(group, "x", "y", "c", "n", "leaf")
        order = np.argsort(leaf, kind="stable")
        x, y, c, n, leaf = (v[order] for v in (x, y, c, n, leaf))
        first = key[0].as_py() * _LEAVES_AT_ONCE
        made = []
        for one in range(first, min(first + _LEAVES_AT_ONCE, len(starts) - 1)):
            if one not in leaf_sums:
                continue
            mine = slice(*np.searchsorted(leaf, [one, one + 1]))
            ax, ay = (_weights(v[mine] - centre[one, a], 0.0, half[one, a]) for a, v in enumerate((x, y)))
            out = np.stack([((ax @ s) * ay).sum(1) for s in leaf_sums[one]], 1)
            for other in sources[starts[one] : starts[one + 1]]:
                a, b = np.searchsorted(leaf, [other, other + 1])
                theirs, step = np.zeros((b - a, classes)), max(1, _AT_ONCE // max(b - a, 1))
                theirs[np.arange(b - a), c[a:b]] = n[a:b]
                for i in range(mine.start, mine.stop, step):
                    some = slice(i, min(i + step, mine.stop))
                    square, up = x[some, None] - x[a:b], y[some, None] - y[a:b]
                    square *= square
                    up *= up
                    square += up
                    out[i - mine.start : some.stop - mine.start] += np.sqrt(square, out=square) @ theirs
            made.append(finish(n[mine], c[mine], out))
        return pa.Table.from_batches(made)

    return sent.groupBy("group").applyInArrow(meet, schema)


def _felt(spark, boxes: Boxes, far: np.ndarray, classes: int) -> list[np.ndarray]:
    """By box the sums at its nodes over the boxes that are far from it."""
    by = np.argsort(far[0], kind="stable")
    targets, sources = far[:, by]
    starts = np.searchsorted(targets, np.arange(len(boxes.left) + 1))
    held = spark.sparkContext.broadcast((boxes.centre, boxes.half, boxes.weights, sources, starts))

    def grid(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.meshgrid(_nodes(half[0]), _nodes(half[1]), indexing="ij")
        return x.ravel(), y.ravel()

    def feel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, half, weights, sources, starts = held.value
        for batch in batches:
            for b in batch["id"].to_pylist():
                x, y = grid(half[b])
                sums = np.zeros((len(x), classes))
                for other in sources[starts[b] : starts[b + 1]]:
                    ox, oy = grid(half[other])
                    square = x[:, None] - (ox + (centre[other, 0] - centre[b, 0]))
                    up = y[:, None] - (oy + (centre[other, 1] - centre[b, 1]))
                    square *= square
                    up *= up
                    square += up
                    sums += np.sqrt(square, out=square) @ weights[other].reshape(classes, -1).T
                columns = [pa.array([b], pa.int64()), pa.array([sums.T.ravel()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "sums"])

    # boxes with the most to feel are dealt evenly
    busy = np.flatnonzero(starts[1:] > starts[:-1])
    nodes = np.prod(np.where(boxes.half > 0, _NODES, 1), 1)
    work = np.add.reduceat(nodes[sources], starts[busy]) * nodes[busy] if len(busy) else busy
    dealt = pd.DataFrame({"id": busy[np.argsort(-work, kind="stable")]})
    dealt["task"] = np.arange(len(dealt)) % _TASKS
    ids = spark.createDataFrame(dealt, "id long, task int").repartitionByRange(_TASKS, "task").select("id")
    shapes = np.where(boxes.half > 0, _NODES, 1)
    out = [np.zeros((classes, *shape)) for shape in shapes]
    if len(busy):
        found = ids.mapInArrow(feel, "id long, sums array<double>").toArrow()
        for b, sums in zip(found["id"].to_pylist(), found["sums"].combine_chunks()):
            out[b] = sums.values.to_numpy().reshape(out[b].shape).copy()
    return out
