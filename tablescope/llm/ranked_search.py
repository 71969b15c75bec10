"""Ranked lexical search by presence masks.

Items are searched in blocks of bounded vocabulary, each block against all documents:

1. One pass over the texts keeps, per document, its length and how often it holds each term of the block.
2. In each batch of documents an item's terms become bitmaps over the documents; read across, they give every document
   the mask of the terms it holds. Documents of one mask form a group, and a group has a maximum score: each of its
   terms as often as the batch has it anywhere, in the group's shortest document.
3. Groups are evaluated by descending maximum until the next one lies below the score of the last place. A task carries
   its best places from batch to batch, so later batches finish sooner; places of all tasks meet at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import materialize, ship_by_value, text_slices, utf8, word_bounds

#: Bounds of a block of items, whose terms are sent to every task: bytes of text and number of items.
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 4096

_SEPARATORS = np.zeros(256, bool)
for _a, _b in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    _SEPARATORS[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts behind one another, and the number of each text's first term (one more at the end)."""
    data, places = utf8(texts)
    starts, ends, first = word_bounds(data, places, _SEPARATORS)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    bytes_ = _LOWER[data[~_SEPARATORS[data]]]
    buffers = [None, pa.py_buffer(sizes), pa.py_buffer(bytes_)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers), first


class Block:
    """Items and their terms. ``terms[i]``: numbers of the terms of item ``i``, each once."""

    def __init__(self, items: list[Row]):
        self.items = items
        words, first = _terms(pa.array([r["text"] for r in items], pa.string()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms = [np.unique(number[a:b]) for a, b in zip(first, first[1:], strict=False)]


def _blocks(items: DataFrame) -> Iterator[Block]:
    rows: list[Row] = []
    size = 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        size += len(row["text"] or "")
        if rows and (size > BLOCK_BYTES or len(rows) == BLOCK_ITEMS):
            yield Block(rows)
            rows, size = [], len(row["text"] or "")
        rows.append(row)
    if rows:
        yield Block(rows)


def term_counts(docs: DataFrame, block: Block) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document that holds any term at all: its number of terms, and the block's
    terms in it with their numbers of occurrences."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )
    vocabulary = block.vocabulary.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        width = max(len(known), 1)
        for batch in batches:
            for part in text_slices(batch):
                words, first = _terms(part.column("text"))
                n = np.diff(first)
                number = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.flatnonzero(number >= 0)
                text = np.searchsorted(first, hit, side="right") - 1
                pair, count = np.unique(text * width + number[hit], return_counts=True)
                edges = np.searchsorted(pair // width, np.arange(len(n) + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(x))
                    for x in ((pair % width).astype(np.int32), count.astype(np.int64))
                ]
                rows = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], schema.names)
                yield rows.filter(pa.array(n > 0))

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``100 - 90 + (90 n N) div L``, exact also where the product leaves 64 bits."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)
    return 10 + 90 * n * documents // max(total, 1)


def _impact(weights: np.ndarray, counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * counts) // np.maximum(1000 * counts + 8 * norm, 1))


def mask_groups(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a matrix (terms by documents) of presence, and each document's group."""
    masks = np.ascontiguousarray(np.packbits(held, axis=0).T)
    keys = masks.view([("mask", f"V{masks.shape[1]}")]).ravel()["mask"]
    _, example, group = np.unique(keys, return_index=True, return_inverse=True)
    return held[:, example], group.reshape(-1)


def best_documents(weights: np.ndarray, counts: np.ndarray, norm: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the ``k`` best, and their scores: all of at least the ``k``-th score and ``least``.

    ``counts``: terms by documents. Groups of equal masks are evaluated by descending maximum score.
    """
    masks, group = mask_groups(counts > 0)
    shortest = np.full(masks.shape[1], np.iinfo(np.int64).max)
    np.minimum.at(shortest, group, norm)
    most = _impact(weights[:, None], counts.max(axis=1)[:, None], shortest)
    maximum = np.where(masks, most, 0).sum(axis=0)
    order = np.argsort(-maximum, kind="stable")
    by_group = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[by_group], np.arange(masks.shape[1] + 1))
    bound = max(least, 1)
    documents, scores = [], []
    done, step = 0, 8
    while done < len(order):
        batch = order[done : done + step]
        batch = batch[maximum[batch] >= bound]
        if not len(batch):
            break
        members = np.concatenate([by_group[edges[g] : edges[g + 1]] for g in batch.tolist()])
        score = _impact(weights[:, None], counts[:, members], norm[members]).sum(axis=0)
        good = score >= bound
        documents.append(members[good])
        scores.append(score[good])
        found = np.concatenate(scores)
        if len(found) >= k:
            bound = max(bound, int(np.partition(found, -k)[-k]))
        done, step = done + step, step * 2
    if not documents:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, score = np.concatenate(documents), np.concatenate(scores)
    return found[score >= bound], score[score >= bound]


def _place(score: int, doc_id) -> tuple:
    """Order of places: higher scores, then smaller ids, null last."""
    return -score, doc_id is None, doc_id.encode() if isinstance(doc_id, str) else 0 if doc_id is None else doc_id


def _best_of_tasks(counted: DataFrame, block: Block, weights: list[int], documents: int, total: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the best places of each task."""
    schema = T.StructType(
        [T.StructField("item", T.IntegerType()), counted.schema["doc_id"], T.StructField("score", T.LongType())]
    )
    terms = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = np.array(weights, np.int64)
        best: list[list[tuple]] = [[] for _ in terms]
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            ids = batch.column("doc_id")
            norm = length_norm(batch.column("n").to_numpy(zero_copy_only=False), documents, total)
            lists = batch.column("terms")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            term = lists.flatten().to_numpy(zero_copy_only=False)
            count = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            document = np.repeat(np.arange(batch.num_rows), sizes)
            order = np.argsort(term, kind="stable")
            term, document, count = term[order], document[order], count[order]
            edges = np.searchsorted(term, np.arange(len(weight_of) + 1))
            for item, own in enumerate(terms):
                own = own[edges[own + 1] > edges[own]] if len(own) else own
                if not len(own):
                    continue
                spots = [slice(edges[t], edges[t + 1]) for t in own.tolist()]
                holders = np.unique(np.concatenate([document[s] for s in spots]))
                counts = np.zeros((len(own), len(holders)), np.int64)
                for row, s in enumerate(spots):
                    counts[row, np.searchsorted(holders, document[s])] = count[s]
                least = best[item][-1][0] if len(best[item]) == k else 0
                found, score = best_documents(weight_of[own], counts, norm[holders], k, least)
                if len(found):
                    rows = zip(score.tolist(), ids.take(pa.array(holders[found])).to_pylist(), strict=True)
                    best[item] = sorted([*best[item], *rows], key=lambda r: _place(*r))[:k]
        rows = [(i, d, s) for i, places in enumerate(best) for s, d in places]
        if rows:
            item, doc_id, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(doc_id, kind), pa.array(score, pa.int64())], schema.names
            )

    return counted.mapInArrow(run, schema)


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    counted = materialize(term_counts(docs, block))
    documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row per term of the block at most
    holding = {r["t"]: r["count"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weights = [weight(documents, holding.get(t, 0)) for t in range(len(block.vocabulary))]
    places = _best_of_tasks(counted, block, weights, documents, total, k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame(
        [(i, r["item_id"]) for i, r in enumerate(block.items)],
        T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", block.kind)]),
    )
    # at most BLOCK_ITEMS rows
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item.

    Every row is a document, and every row of ``items`` is an item: repeated rows are answered one by one, each document
    row may take a rank, and equal scores rank by ascending ``doc_id``, null last. Null and empty texts hold no term, so
    such documents are not found and such items find nothing. Empty tables give an empty result. Other columns are not
    read.
    """
    ship_by_value()
    made = None
    for block in _blocks(items):
        block.kind = items.schema["item_id"].dataType
        part = _search_block(docs, block, k)
        made = materialize(part) if made is None else made.unionByName(materialize(part))
    if made is None:
        schema = T.StructType(
            [items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())]
        )
        return docs.sparkSession.createDataFrame([], schema)
    return made
