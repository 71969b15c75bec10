"""Vector best-fit packing of token sequences.

Each bin has three capacities: tokens, documents and attention cost (the sum of squared lengths). What a piece needs
follows from its length alone, so the plan is made on the histogram of lengths: at most ``capacity`` numbers, however
many documents there are. Pieces of a length are numbered across all tasks, and a piece's number names its bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import materialize, ship_by_value, text_slices, utf8
from tablescope.llm.transducer import character_classes, transducer

CAPACITY = 2048


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin and the weights of their residuals. ``None``: what ``tokens`` implies, so never binding.

    ``rule``: ``norm`` takes the bin whose weighted residual is smallest after the piece went in, ``dot`` the one whose
    residual has the smallest weighted product with the piece (the tightest fit along the piece's own needs).
    """

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def capacities(self) -> np.ndarray:
        return np.array(
            [
                self.tokens,
                self.documents if self.documents is not None else self.tokens,
                self.attention if self.attention is not None else self.tokens**2,
            ],
            np.int64,
        )


#: A row of the plan: pieces of ``length`` with numbers from ``first`` on, ``count`` of them, ``per_bin`` to a bin,
#: in bins from ``bin`` on, the first at ``offset``.
PLAN = ("length", "first", "count", "per_bin", "bin", "offset")


def plan_bins(lengths: np.ndarray, counts: np.ndarray, limits: Limits) -> np.ndarray:
    """Best-fit decreasing over groups of equal pieces and groups of equal bins; one row per placement.

    Equal bins are filled alike, and a bin that was the best fit remains it while the piece still fits, so whole groups
    move at once and the work does not grow with the number of pieces.
    """
    full = limits.capacities()
    weight = np.array(limits.weights, float)
    if (lengths > full[0]).any() or ((lengths.astype(np.int64) ** 2) > full[2]).any() or full[1] < 1:
        raise ValueError("a piece does not fit into an empty bin")
    residual = np.zeros((0, 3), np.int64)
    groups: list[tuple[int, int]] = []  # first bin and number of bins, beside each row of residual
    plan: list[tuple[int, ...]] = []
    bins = 0
    for length, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        done = 0
        fits = np.flatnonzero((residual >= need).all(1))
        if len(fits):
            left = residual[fits] - need
            if limits.rule == "dot":
                rank = ((residual[fits] / full) * (need / full) * weight).sum(1)
            else:
                rank = np.sqrt((weight * (left / full) ** 2).sum(1))
            fits = fits[np.lexsort((fits, rank))]
        spent, made = [], []
        for g in fits.tolist():
            if done == count:
                break
            first, n = groups[g]
            room = int((residual[g][need > 0] // need[need > 0]).min())
            take = min(room * n, count - done)
            used, rest = divmod(take, room)
            plan.append((length, done, take, room, first, int(full[0] - residual[g][0])))
            done += take
            spent.append(g)
            for start, size, k in ((first, used, room), (first + used, 1 if rest else 0, rest)):
                if size:
                    made.append((residual[g] - k * need, (start, size)))
            if (touched := used + bool(rest)) < n:
                made.append((residual[g], (first + touched, n - touched)))
        if done < count:
            room = int((full[need > 0] // need[need > 0]).min())
            used, rest = divmod(count - done, room)
            plan.append((length, done, count - done, room, bins, 0))
            for start, size, k in ((bins, used, room), (bins + used, 1 if rest else 0, rest)):
                if size:
                    made.append((full - k * need, (start, size)))
            bins += used + bool(rest)
        if spent or made:
            keep = np.ones(len(groups), bool)
            keep[spent] = False
            made = [m for m in made if m[0].min() > 0]
            residual = np.concatenate([residual[keep], np.array([m[0] for m in made], np.int64).reshape(-1, 3)])
            groups = [g for g, k in zip(groups, keep, strict=True) if k] + [m[1] for m in made]
    return np.array(plan, np.int64).reshape(-1, len(PLAN))


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces of the tokenised documents, with the writing task and the piece's number among its task's equal lengths.

    ``doc_id, piece, start, length, ids_crc32, task, nth``. A document is its ids and ``end``; only what is longer than
    ``capacity`` is cut, and then its first piece takes what the others leave over.
    """
    ship_by_value()
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()
    classes = character_classes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(vocabulary, classes)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                doc, piece, start, length, crc, nth = [], [], [], [], [], []
                ids_of, places = compiled.ids(*utf8(part.column("text")))
                raw, edges = ids_of.tobytes(), (places * 4).tolist()
                for doc_id, x, y in zip(part.column("doc_id").to_pylist(), edges, edges[1:], strict=False):
                    ids = raw[x:y] + last
                    n = len(ids) // 4
                    a, k = 0, 0
                    while a < n:
                        b = a + ((n - a - 1) % capacity) + 1 if a == 0 else a + capacity
                        doc.append(doc_id)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                        nth.append(int(seen[b - a]))
                        seen[b - a] += 1
                        a, k = b, k + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, part.column("doc_id").type),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([task] * len(doc), pa.int32()),
                        pa.array(nth, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return chosen.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
    )


def pack(docs: DataFrame, vocabulary: str, limits: Limits | None = None, end: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed as often as they come. An empty
    table gives an empty result. Sequences are gapless from offset 0.
    """
    limits = limits or Limits()
    pieces = materialize(tokenized_pieces(docs, vocabulary, limits.tokens, end))
    # one row per task and length at most: the pieces of a length get numbers across all tasks
    counted = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counted = materialize(counted.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")))
    # at most one row per length
    sizes = counted.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()
    plan = plan_bins(np.array([r["length"] for r in sizes], np.int64), np.array([r["n"] for r in sizes], np.int64), limits)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    numbered = pieces.join(counted.select("length", "task", "before"), ["length", "task"])
    chosen = numbered.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number")
    )
    kind = chosen.schema["doc_id"].dataType.simpleString()
    lengths, begins = np.unique(plan[:, 0], return_index=True)
    ends = np.append(begins[1:], len(plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            row = np.zeros(batch.num_rows, np.int64)
            for value in np.unique(length):
                k = np.searchsorted(lengths, value)
                at = length == value
                first = plan[begins[k] : ends[k], 1]
                row[at] = begins[k] + np.searchsorted(first, number[at], side="right") - 1
            _, first, _, per_bin, bin_, offset = plan[row].T if batch.num_rows else np.zeros((6, 0), np.int64)
            k = number - first
            made = [pa.array(bin_ + k // per_bin), pa.array(offset + k % per_bin * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], [*batch.schema.names[:5], "sequence_id", "offset"])

    return chosen.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
