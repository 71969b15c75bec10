"""SimHash near-duplicates with pivot distance tables.

The fingerprints' Hamming distances to a fixed set of reference fingerprints are computed once. Two fingerprints that
differ in few bits have nearly equal distances to every reference, so a pair whose largest coordinate difference
exceeds the bound is discarded without being compared, and only survivors are verified.

In 64 dimensions distances to random references lie close together, so the table alone would have to meet every pair
of fingerprints. Pairs are therefore brought together by blocks of bits first: of ``n`` blocks, a linked pair agrees
in all but ``bits``. This loses no link whatever ``n`` is; ``n`` follows the number of fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import free_names, materialize, mix, ship_by_value, text_key, utf8
from tablescope.llm.components import connected

WORDS = 4
BITS = 4
PIVOTS = 16
#: Fingerprints that one task compares with one another at a time; larger groups are cut into pairs of such chunks.
CHUNK = 1024
_SHINGLES_AT_ONCE = 1 << 16


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 (seed 42), repeats included; no word gives 0."""
    parts = text.lower().split()  # of bytes: A-Z only, and white space is 0x20, 0x09 to 0x0D
    if not parts:
        return 0
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1, out=begins[1:])
    ends = begins[min(words, len(parts)) :] - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _SHINGLES_AT_ONCE):
        spans = zip(begins[k : k + _SHINGLES_AT_ONCE].tolist(), ends[k : k + _SHINGLES_AT_ONCE].tolist())
        hashes = np.array([digest(line[a:b], 42) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, bits``: the fingerprint as a signed 64-bit number; a null text counts as empty."""
    ship_by_value()
    chosen = docs.select(*keys, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{k} {chosen.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = utf8(batch.column("text"))
            view = data.tobytes()
            got = np.array([fingerprint(view[a:b], words) for a, b in itertools.pairwise(places.tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], [*keys, "bits"])

    return chosen.mapInArrow(run, f"{kinds}, bits long")


def block_masks(n: int, bits: int = BITS) -> list[int]:
    """For each choice of all but ``bits`` blocks out of ``n``, the mask of their bits, as signed numbers."""
    cuts = [round(64 * k / n) for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(blocks, n - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(rows: int, bits: int = BITS) -> int:
    """The fewest blocks whose kept bits tell about ``rows`` values apart; at least two blocks are kept."""
    n = bits + 2
    while n < 16 and 64 * (n - bits) / n < np.log2(max(rows, 2)):
        n += 1
    return n


def _linked(key: np.ndarray, chunk: np.ndarray, cross: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """Edges of a spanning forest of each group's links, as pairs of positions.

    ``key``: group of each row, groups contiguous and ordered by the distance to the first pivot. Row i is compared
    with row i + k for growing k; it drops out where the group ends or the first coordinate is too far off, the rest
    of the table discards what it can, and only survivors that are not yet connected are verified.
    """
    table = np.bitwise_count(x[:, None] ^ pivots()[None, :]).astype(np.int8)
    parent = np.arange(len(x))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges: list[tuple[int, int]] = []
    label = parent.copy()
    active = np.arange(len(x) - 1)
    k = 1
    while len(active):
        active = active[active + k < len(x)]
        other = active + k
        near = (key[active] == key[other]) & (table[other, 0] - table[active, 0] <= bits)
        active = active[near]
        a, b = active, active + k
        keep = (label[a] != label[b]) & ~(cross[a] & (chunk[a] == chunk[b]))
        a, b = a[keep], b[keep]
        for p in range(1, table.shape[1]):
            if not len(a):
                break
            keep = np.abs(table[a, p] - table[b, p]) <= bits
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(x[a] ^ x[b]) <= bits
        a, b = a[keep], b[keep]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            ri, rj = root(i), root(j)
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
                edges.append((i, j))
        if len(a):
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent.copy()
        k += 1
    return np.array(edges, np.int64).reshape(-1, 2)


def links(distinct: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links between different fingerprints that connect all that are within ``bits`` bits of one another.

    ``distinct`` has one column ``bits`` without repeats. Within a group only a spanning forest is returned, so a group
    of near copies gives as many rows as it has members, not their pairs.
    """
    ship_by_value()
    masks = block_masks(blocks_for(distinct.count(), bits), bits)
    first = pivots(1).view(np.int64)[0]
    keyed = distinct.select(
        "bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "block")
    )
    sizes = keyed.groupBy("choice", "block").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("bits"), chunks).cast("int")
    grouped = keyed.join(sizes, ["choice", "block"]).select(
        "choice",
        "block",
        "bits",
        F.bit_count(F.col("bits").bitwiseXOR(F.lit(int(first)))).alias("far"),
        own.alias("chunk"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("with"),
    )
    pair = [F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high")]
    group = ["choice", "block", "low", "high"]
    rows = (
        grouped.select("choice", "block", *pair, "far", "chunk", "bits")
        .repartition(*group)
        .sortWithinPartitions(*group, "far", "bits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(table: pa.RecordBatch) -> pa.RecordBatch:
            choice, block, low, high, _, part, x = (c.to_numpy(zero_copy_only=False) for c in table.columns)
            new = np.ones(len(x), bool)
            new[1:] = (np.diff(choice) != 0) | (np.diff(block) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
            found = _linked(np.cumsum(new), part, low != high, x.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(x[found[:, 0]]), pa.array(x[found[:, 1]])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = [c[-1].as_py() for c in whole.columns[:4]]
            same = np.ones(whole.num_rows, bool)
            for c, v in zip(whole.columns[:4], last, strict=True):
                same &= c.to_numpy(zero_copy_only=False) == v
            cut = whole.num_rows - int(same.sum())
            if cut:
                yield edges(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if held:
            yield edges(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``bits, root, component_id`` of every different fingerprint of a table with ``doc_id, bits``: a fingerprint that
    stands for its group, and the group's smallest ``doc_id``."""
    nodes = materialize(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = materialize(connected(links(nodes.select("bits"), bits)))
    linked = nodes.join(roots, F.col("bits") == F.col("vertex")).select("bits", "least", "root")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(smallest, "root").select("bits", "root", "component_id")
    found = nodes.join(linked, "bits", "left").select(
        "bits", F.coalesce("root", "bits").alias("root"), F.coalesce("component_id", "least").alias("component_id")
    )
    # stored, so that both sides of a later join are plain shuffles and a hot fingerprint can be split
    return materialize(found)


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest ``doc_id`` that can be reached over
    links of at most ``bits`` differing bits, itself included. Null, empty and wordless texts have fingerprint zero and
    are linked like any other. Repeated rows are returned as often as they come; a null ``doc_id`` is never the
    smallest unless a component has no other.
    """
    prints = materialize(fingerprints(docs, words))
    return prints.join(groups(prints, bits), "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the smallest ``doc_id`` (null last), and one row of it.

    Null, empty and wordless texts are one group, as they share fingerprint zero. Of rows that are equal in id and text
    one stays, whichever has other columns. Columns of any name are kept as they are.
    """
    first_ref, second_ref, number = free_names(docs, "ref", "ref2", "number")
    key = {"doc_id": F.col("doc_id")} | dict(zip((first_ref, second_ref), text_key(), strict=True))
    prints = materialize(
        fingerprints(docs.select(*[c.alias(k) for k, c in key.items()], "text"), words, tuple(key))
    )
    found = groups(prints, bits).select("bits", "root")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), *key)
    kept = prints.join(found, "bits").groupBy("root").agg(F.min(first).alias("first")).select("first.*")
    keyed = docs.withColumns({k: c for k, c in key.items() if k != "doc_id"})
    same = [keyed[k].eqNullSafe(kept[k]) for k in key]
    stays = keyed.join(kept, same[0] & same[1] & same[2], "left_semi")
    # rows that are equal in id and text are one document
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return stays.withColumn(number, place).where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
