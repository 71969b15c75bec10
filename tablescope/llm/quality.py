"""Quality classifier by compression: one zstandard dictionary from good texts, one from bad ones.

A text is cut into blocks; each is compressed with either dictionary. The difference of both sizes over their sum, zero
when both dictionaries help alike, is turned into a probability by a logistic curve. The curve also sees how far the text
shrinks at all, since text that repeats itself shrinks under both dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import crc_remainder, labelled_sample, ship_by_value, text_slices, utf8, with_column

#: Labelled texts of each class that dictionaries and curve are fitted on (a documented bound).
SAMPLE_ROWS = 4000
#: Bytes of a sampled text that a dictionary is made of, bytes of a dictionary, and bytes of a block.
LEARN_BYTES = 4096
DICTIONARY_BYTES = 1 << 16
BLOCK_BYTES = 2048
THRESHOLD = 0.3


@dataclass
class CompressionModel:
    """Both dictionaries and the curve; ``constant`` replaces them where a class has no labelled text."""

    good: bytes = b""
    bad: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little text for training, the text itself serves."""
    blocks = [s[k : k + BLOCK_BYTES] for s in samples for k in range(0, len(s), BLOCK_BYTES)]
    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), blocks, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY_BYTES] or b"\0" * 8


def _compressors(model: CompressionModel) -> list:
    made = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=3)
        made.append(
            zstandard.ZstdCompressor(
                dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress
        )
    return made


def _features(text: memoryview, compress: list) -> tuple[float, float, float]:
    """Size difference over the size, size per byte of text, and the size per byte of the block that shrinks most."""
    n = len(text)
    if not n:
        return 0.0, 1.0, 1.0
    good = bad = 0
    least = 1.0
    for k in range(0, n, BLOCK_BYTES):
        block = text[k : k + BLOCK_BYTES]
        a, b = len(compress[0](block)), len(compress[1](block))
        good += a
        bad += b
        least = min(least, (a + b) / (2 * len(block) + 64))
    return (bad - good) / (bad + good), (bad + good) / (2 * n + 64), least


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p) + 1e-9)[:, None]) + ridge, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _text_features(texts: pa.Array, compress: list) -> np.ndarray:
    """Three numbers for each whole text."""
    data, places = utf8(texts)
    view = memoryview(np.ascontiguousarray(data))
    made = [_features(view[a:b], compress) for a, b in zip(places[:-1], places[1:], strict=True)]
    return np.array(made).reshape(-1, 3)


def _curve_points(sample: DataFrame, good: bytes, bad: bytes) -> list:
    """Label and features of each whole text, found in the tasks that hold the texts."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressors(CompressionModel(good, bad))
        for batch in batches:
            for part in text_slices(batch):
                x = _text_features(part.column("text"), compress)
                columns = [part.column("label"), part.column("place"), *(pa.array(c) for c in x.T)]
                yield pa.RecordBatch.from_arrays(columns, ["label", "place", "a", "b", "c"])

    kind = "label int, place long, a double, b double, c double"
    return sample.select("label", "place", "text").mapInArrow(run, kind).orderBy("label", "place").collect()


def fit(docs: DataFrame, labels: DataFrame, held_out=None, rows: int = SAMPLE_ROWS) -> CompressionModel:
    """Fit on at most ``rows`` labelled texts per class.

    ``held_out`` is a condition on ``doc_id`` that keeps rows from being learned; by default crc32 of the id, modulo
    5, is 0. Rows with null or other labels are not used. Half of the sample gives the dictionaries (``LEARN_BYTES``
    from the middle of each text, as a dictionary holds few), the other half, whole and weighted back to the class
    sizes, the curve; so the curve never sees what a dictionary was made of, and learns from texts as they are scored.
    """
    held_out = crc_remainder(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    sample = labelled_sample(docs, labels, "quality", held_out, rows)
    if not sample.usable:
        return CompressionModel(constant=sample.prior)
    texts = sample.docs.where(F.octet_length("text") > 0)
    first = F.pmod("place", F.lit(2)) == 0
    # a bounded number of bounded pieces: 2 * rows * LEARN_BYTES bytes at most
    piece = F.substring(
        F.encode("text", "utf-8"), F.greatest(F.lit(1), (F.octet_length("text") - LEARN_BYTES) / 2).cast("int"), LEARN_BYTES
    )
    got = texts.select("label", "place", first.alias("first"), piece.alias("piece")).orderBy("place", "piece").collect()
    part = {k: [bytes(r["piece"]) for r in got if r["label"] == k] for k in (0, 1)}
    if not all(part.values()):
        return CompressionModel(constant=sample.prior)
    own = {k: [bytes(r["piece"]) for r in got if r["label"] == k and r["first"]] or part[k] for k in (0, 1)}
    model = CompressionModel(good=_dictionary(own[1]), bad=_dictionary(own[0]))
    points = _curve_points(texts.select("label", "place", "text"), model.good, model.bad)
    rest = {k: [r for r in points if r["label"] == k and r["place"] % 2] for k in (0, 1)}
    rest = {k: v or [r for r in points if r["label"] == k] for k, v in rest.items()}
    x = np.array([(r["a"], r["b"], r["c"]) for k in (0, 1) for r in rest[k]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    total = sum(sample.sizes.values())
    w = np.concatenate([np.full(len(rest[k]), sample.sizes[k] / total * len(y) / len(rest[k])) for k in (0, 1)])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = _design(x, centre, scale)
    beta = _logistic(z, y, w)
    model.centre, model.scale, model.weights = tuple(centre), tuple(scale), tuple(beta)
    return model


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The size difference, and how well the text shrinks at all: text that repeats itself shrinks far too well."""
    z = np.clip((x - centre) / scale, -6, 6)
    return np.column_stack([z, z[:, 1:] ** 2])


def with_score(docs: DataFrame, model: CompressionModel, name: str = "score") -> DataFrame:
    """``docs`` and the probability that its ``text`` is good (null: as the empty text)."""

    def values():
        if model.constant is not None:
            return lambda texts: np.full(len(texts), model.constant)
        compress = _compressors(model)
        centre, scale, beta = (np.array(x) for x in (model.centre, model.scale, model.weights))

        def of(texts: pa.Array) -> np.ndarray:
            z = _design(_text_features(texts, compress), centre, scale)
            return 1 / (1 + np.exp(-np.clip(z @ beta[:-1] + beta[-1], -30, 30)))

        return of

    return with_column(docs, name, values)


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Empty and null texts get the score of an empty text; repeated rows get equal scores; without labelled texts of
    both classes every score is the share of label 1 (a half without any label).
    """
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = with_score(chosen, fit(docs, labels, rows=rows))
    return out.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
