"""What the operators share: Arrow text batches as byte arrays, vectorised words and hashes, labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.plans.shipping import ship_by_value
from tablescope.plans.storage import materialize

__all__ = [
    "LabelledSample",
    "crc_remainder",
    "free_names",
    "labelled_sample",
    "materialize",
    "mix",
    "ship_by_value",
    "text_key",
    "text_slices",
    "utf8",
    "with_column",
    "word_bounds",
    "word_hashes",
    "word_line",
    "word_names",
]

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
SLICE_BYTES = 1 << 20
#: Odd base of the polynomial word hash and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind one another and the places where they begin; null counts as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    places = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, or one row."""
    _, places = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(places, places[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(
    data: np.ndarray, places: np.ndarray, separators: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of the first of its words (one more at the end)."""
    inside = ~separators[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(places), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = places[(places > 0) & (places < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, places)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range for features: some long ranges share it (see ``word_names``)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1 + seed)) * _powers(_BASE, len(data))[:-1], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64) + np.uint64(seed)))


def word_line(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with one space between the words of a text: bytes, texts' places, and the bounds of ``word_bounds``.

    A text may begin or end with a space; between two of its words there is exactly one.
    """
    data, places = utf8(texts)
    blank = _SPACE[data]
    kept = ~blank
    kept[1:] |= ~blank[:-1]  # the first blank behind a word
    line = np.where(blank, np.uint8(0x20), data)[kept]
    places = np.concatenate([[0], np.cumsum(kept)])[places]
    return line, places, *word_bounds(line, places)


#: Bytes from which a word is hashed by itself.
_LONG_WORD = 128


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; eight bytes are mixed at a time, so ranges of up to eight bytes never collide
    with others of their length."""
    size = ends - starts
    whole = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    whole[: len(data)] = data
    eight = whole.view("<u8")
    name = mix(size.astype(np.uint64))
    live = np.flatnonzero(size < _LONG_WORD)
    offset = 0
    while len(live):
        at = starts[live] + offset
        left = np.minimum(size[live] - offset, 8)
        shift = ((at & 7) * 8).astype(np.uint64)
        value = eight[at >> 3] >> shift
        # two shifts, as one by 64 bits is undefined
        value |= eight[(at >> 3) + 1] << (np.uint64(63) - shift) << np.uint64(1)
        value &= ~np.uint64(0) >> ((8 - left) * 8).astype(np.uint64) % np.uint64(64)
        name[live] = mix(name[live] ^ value) + np.uint64(offset + 1)
        offset += 8
        live = live[size[live] > offset]
    for k in np.flatnonzero(size >= _LONG_WORD).tolist():
        name[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return name


def text_key() -> list[Column]:
    """Two 64-bit hashes of the text; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("ref"), F.xxhash64(F.lit(1), text).alias("ref2")]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, longer where the table has them already (names do not tell capitals apart)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def with_column(docs: DataFrame, name: str, values) -> DataFrame:
    """``docs`` and a double column that ``values`` makes of each batch's texts.

    ``values()`` is called once per task and returns a function from a text array to numbers.
    """
    ship_by_value()
    kind = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = values()
        for batch in batches:
            for part in text_slices(batch.rename_columns([f"c{k}" for k in range(batch.num_columns)]), f"c{text}"):
                column = pa.array(made(part.column(text)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*docs_names, name])

    docs_names = list(docs.columns)
    return docs.mapInArrow(run, kind)


class LabelledSample:
    """At most ``rows`` labelled documents per class, drawn by a hash of the id, with the class sizes behind them."""

    def __init__(self, docs: DataFrame, sizes: dict[int, int]):
        self.docs = docs
        self.sizes = sizes

    @property
    def usable(self) -> bool:
        return all(self.sizes.get(k, 0) for k in (0, 1))

    @property
    def prior(self) -> float:
        """Share of label 1 among all labelled rows; a half where there are none."""
        total = sum(self.sizes.values())
        return self.sizes.get(1, 0) / total if total else 0.5


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int, most_bytes: int | None = None
) -> LabelledSample:
    """Join a bounded sample of the labels to their texts; ``doc_id, text, label, place``, stored.

    ``held_out``: the condition on ``doc_id`` of rows that must not be learned from. The sampled ids are broadcast:
    there are at most ``2 * rows`` of them. A document with two labels counts as label 1. Of the texts of a repeated id
    the one with the smallest hash is taken, so the bound holds for texts too. ``place`` orders the sample by a hash of
    the id; with ``most_bytes`` it ends in each class before the text that would exceed half of them, but never before
    the first. Texts are taken whole.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(~held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.xxhash64("doc_id", F.lit(11))
    chosen = None
    for k in sorted(sizes):
        # the cut on the hash leaves a little more than `rows`; the limit makes the bound strict
        share = min(1.0, 1.1 * rows / sizes[k] + 200 / sizes[k])
        part = known.where(F.col("label") == k).where(F.pmod(place, F.lit(1 << 20)) < int(share * (1 << 20)))
        part = part.orderBy(place, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    drawn = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    one = drawn.agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    found = one.select("doc_id", F.col("least.text").alias("text"), "label", F.xxhash64("doc_id", F.lit(23)).alias("place"))
    found = materialize(found)
    if most_bytes is not None:
        # one row per sampled text: at most 2 * rows numbers
        lengths = found.select("label", "place", F.octet_length("text").alias("n")).orderBy("label", "place", "n").collect()
        ends = {}
        for k in (0, 1):
            total = 0
            for n, r in enumerate(x for x in lengths if x["label"] == k):
                total += r["n"]
                if n and total > most_bytes // 2:
                    ends[k] = r["place"]
                    break
        for k, end in ends.items():
            found = found.where((F.col("label") != k) | (F.col("place") < end))
    return LabelledSample(found, sizes)
