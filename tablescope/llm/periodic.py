"""Periodic runs of words, found in tiles of every scale.

A run of period ``q`` lies in the octave ``S <= q < 2S`` (``S`` a power of two).

1. Per octave a document has a boundary every ``S`` words. A run of four periods holds some boundary ``b`` such that
   ``2S`` words from ``b`` on equal those from ``b + q`` on (four words where ``S = 1``). Blocks of ``2S`` words are
   named by doubling, so one comparison of two neighbouring rows of names finds all such pairs of an octave.
   Boundaries with pairs are gathered in tiles of ``GROUP`` boundaries that overlap their neighbours; a tile is a row.
2. Each tile is solved by itself: Z-functions forward and backward from a boundary give, for all periods at once, how
   far the words agree, so where a fragment begins and ends inside the tile.
3. Fragments are shuffled by document and period and stitched: fragments of one run overlap by more than its period,
   those of two runs by less.

Documents without any pair are answered in the first step. The text of the others is stored and met again by the runs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import materialize, mix, ship_by_value, text_slices, word_line

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Boundaries of a tile.
GROUP = 16
#: Words of tiles that are sent on at a time.
BATCH_WORDS = 1 << 20

Runs = list[tuple[int, int, int]]


def _block(octave: int) -> int:
    """Words of the blocks that are compared."""
    return 4 if octave == 0 else 2 << octave


class _Words:
    """The words of a slice of texts: single spaces between them, equal words with equal numbers."""

    def __init__(self, texts: pa.Array):
        data, self.places, self.starts, self.ends, self.first = word_line(texts)
        self.raw = data.tobytes()
        sizes = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(sizes), pa.py_buffer(data[data != 0x20])]
        )
        self.number = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else sizes[:0]

    def joined(self, t: int, order: np.ndarray | None) -> bytes:
        """The words of a text, in another order if there is one, with one space between them."""
        if order is None or not len(order):
            return self.raw[self.places[t] : self.places[t + 1]].strip(b" ")
        a, n = int(self.first[t]), int(order.max()) + 1
        words = [self.raw[x:y] for x, y in zip(self.starts[a : a + n].tolist(), self.ends[a : a + n].tolist(), strict=True)]
        return b" ".join([words[k] for k in order.tolist()])


def _pairs(numbers: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per octave: text, boundary (a word of the text) and period of each pair of equal blocks."""
    sizes = np.array([len(x) for x in numbers], np.int64)
    live = np.flatnonzero(sizes >= LEAST_WORDS)
    if not len(live):
        return
    # texts one behind another, a number of its own behind each
    line = np.concatenate([np.append(numbers[t], -1 - t) for t in live])
    begin = np.append(0, np.cumsum(sizes[live] + 1)[:-1])
    names = mix(line.view(np.uint64) + np.uint64(0x51ED270B))
    have = 1
    octave = 0
    while len(live):
        step, block = 1 << octave, _block(octave)
        while have < block:
            tail = mix(np.arange(len(names), dtype=np.uint64) + np.uint64(have << 40))
            tail[: len(names) - have] = names[have:]
            names = mix(names * np.uint64(3) + mix(tail))
            have *= 2
        rows = len(names) // step
        grid = names[: rows * step].reshape(rows, step)
        row, column = np.nonzero(grid[1:] == grid[:-1, :1])
        if len(row):
            at = row.astype(np.int64) * step
            which = np.searchsorted(begin, at, side="right") - 1
            yield octave, live[which], at - begin[which], column.astype(np.int64) + step
        octave += 1
        stay = sizes[live] >= max(LEAST_WORDS, LEAST_PERIODS << octave)
        if stay.sum() and (sizes[live][stay] + 1).sum() < 0.7 * len(names):
            inside = np.repeat(stay, sizes[live] + 1)
            names = names[inside]
            live = live[stay]
            begin = np.append(0, np.cumsum(sizes[live] + 1)[:-1])
        elif not stay.sum():
            return


def _tiles(octave: int, size: int, boundary: np.ndarray, period: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First word, end and pairs (boundary in the tile, period) of the tiles of one text."""
    step = 1 << octave
    group = boundary // (GROUP * step)
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(group)], strict=True):
        first = max(0, int(boundary[a]) - step)
        end = min(size, int(boundary[b - 1]) + 5 * step + 4)
        yield first, end, np.stack([boundary[a:b] - first, period[a:b]], 1)


def z_function(s: list) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def _parts(q: int) -> tuple[int, ...]:
    """``q`` divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def solve(words: np.ndarray, pairs: np.ndarray, octave: int) -> Runs:
    """``start, end, period`` of the fragments of a tile whose smallest period lies in the octave."""
    block = _block(octave)
    line = words.tolist()
    covered: dict[int, tuple[int, int]] = {}
    out = []
    edges = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    for part in np.split(pairs, edges):
        b = int(part[0, 0])
        open_ = [q for q in part[:, 1].tolist() if not (q in covered and covered[q][0] <= b and b + q + block <= covered[q][1])]
        if not open_:
            continue
        ahead = z_function(line[b:])
        far = max(open_)
        back = z_function([*line[b - 1 :: -1], None, *line[b + far - 1 :: -1]]) if b else None
        for q in open_:
            more = ahead[q]
            if more < block:  # names were equal, words are not
                continue
            before = back[b + 1 + far - q] if back else 0
            covered[q] = (b - before, b + q + more)
            if not any(ahead[d] >= q + more - d for d in _parts(q)):
                out.append((*covered[q], q))
    return out


def _explode(docs: DataFrame, values, kind: T.StructType, edit) -> DataFrame:
    """Rows of documents (``octave`` is null) and of tiles; ``key`` is the row's document.

    Documents without a pair carry their values, the others their words in ``joined``.
    """
    doc_kind = docs.schema["doc_id"]
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("doc_id", doc_kind.dataType),
            T.StructField("octave", T.IntegerType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("words", T.BinaryType()),
            T.StructField("pairs", T.BinaryType()),
            T.StructField("joined", T.StringType()),
            T.StructField("value", kind),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        key = TaskContext.get().partitionId() << 33

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[*c] for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for part in text_slices(batch):
                w = _Words(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                size = np.diff(w.first)
                orders = [edit(i, int(n)) if edit else None for i, n in zip(ids, size, strict=True)]
                numbers = [w.number[a:b] if o is None else w.number[a:b][o] for a, b, o in zip(w.first, w.first[1:], orders, strict=False)]
                rows, held, seen = [], 0, set()
                for octave, text, boundary, period in _pairs(numbers):
                    edges = np.flatnonzero(np.diff(text)) + 1
                    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(text)], strict=True):
                        t = int(text[a])
                        seen.add(t)
                        for first, end, pairs in _tiles(octave, int(size[t]), boundary[a:b], period[a:b]):
                            words = numbers[t][first:end].astype("<i4").tobytes()
                            rows.append((key + t, None, octave, first, words, pairs.astype("<i4").tobytes(), None, None))
                            held += end - first + 2 * len(pairs)
                            if held > BATCH_WORDS:
                                yield out(rows)
                                rows, held = [], 0
                for t, doc_id in enumerate(ids):
                    joined = w.joined(t, orders[t])
                    if t in seen:
                        rows.append((key + t, doc_id, None, None, None, None, joined.decode(), None))
                    else:
                        rows.append((key + t, doc_id, None, None, None, None, None, dict(zip(kind.names, values(joined, []), strict=True))))
                yield out(rows)
                key += len(ids)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _solved(tiles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("key", "octave", "place", "words", "pairs"))
            for key, octave, place, words, pairs in zip(*columns, strict=True):
                found = solve(np.frombuffer(words, "<i4"), np.frombuffer(pairs, "<i4").reshape(-1, 2), octave)
                rows += [(key, q, place + a, place + b) for a, b, q in found]
            made = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made.T], ["key", "period", "start", "end"])

    return tiles.select("key", "octave", "place", "words", "pairs").mapInArrow(
        run, "key long, period long, start long, end long"
    )


def _stitched(fragments: DataFrame) -> DataFrame:
    """``key, runs``: maximal runs of each document, by start and period."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= reached - F.col("period"), 0).otherwise(1)
    pieces = fragments.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    whole = pieces.groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    long_ = whole.where((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period")))
    return long_.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def with_runs(
    docs: DataFrame,
    values: Callable[[bytes, Runs], tuple],
    kind: str,
    edit: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``doc_id`` and what ``values`` makes of each text's words (joined by one space) and runs.

    Runs are ``start, length, period`` by start and period, counted in words. ``edit(doc_id, n)`` may give another
    order of a document's ``n`` words, as places in it. Every row is a document of its own: repeated rows and ids are
    answered one by one. Null and empty texts have no word and no run. An empty table gives an empty result.
    """
    ship_by_value()
    schema = T.StructType.fromDDL(kind)
    stored = materialize(_explode(docs, values, schema, edit))
    plain = stored.where("octave IS NULL AND joined IS NULL").select("doc_id", "value.*")
    runs = _stitched(_solved(stored.where("octave IS NOT NULL")))
    open_ = stored.where("joined IS NOT NULL").select("key", "doc_id", "joined").join(runs, "key", "left")
    result = T.StructType([docs.schema["doc_id"], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        for batch in batches:
            made = []
            for joined, found in zip(batch.column("joined").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                made.append(values(joined.encode(), [(r["start"], r["length"], r["period"]) for r in found or []]))
            columns = zip(*made, strict=True) if made else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([*c], f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))],
                schema=arrow,
            )

    return plain.unionByName(open_.select("doc_id", "joined", "runs").mapInArrow(run, result))


def collapse(joined: bytes, runs: Runs) -> bytes:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return joined
    words = joined.split(b" ")
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    return b" ".join([words[k] for k in stay.tolist()])


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs``: every run of each text."""

    def values(joined: bytes, runs: Runs) -> tuple:
        return len(joined.split(b" ")) if joined else 0, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]

    return with_runs(docs, values, "n_words long, runs array<struct<start: long, length: long, period: long>>")


def collapsed(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: each text's words, joined by one space, every run cut to its first period."""
    return with_runs(docs, lambda joined, runs: (collapse(joined, runs).decode(),), "text string")


def _digest(joined: bytes, runs: Runs) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (
        len(runs),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(collapse(joined, runs)).hexdigest(),
    )


def repeated_tail(doc_id, n: int) -> np.ndarray | None:
    """For one id in ten the order of words in which the tail of the text is a repetition of its first words."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def digest(docs: DataFrame) -> DataFrame:
    """Digests of the runs and of the collapsed text, after the edit of ``repeated_tail``."""
    kind = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return with_runs(docs, _digest, kind, repeated_tail)
