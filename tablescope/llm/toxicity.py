"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

The whole of a bounded labelled sample is learned in one task with per-coordinate rates: averaging the weights of parts,
each with the same L1 on fewer texts, would lose weights that one part alone keeps. L1 leaves a few thousand weights,
which are broadcast as two arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import (
    crc_remainder,
    labelled_sample,
    mix,
    ship_by_value,
    text_slices,
    utf8,
    with_column,
    word_bounds,
    word_hashes,
)

#: Labelled texts of each class that the weights are learned from (a documented bound).
SAMPLE_ROWS = 6000
#: Bytes of text that one task learns from (a documented bound; whole texts, half of it for each class).
SAMPLE_BYTES = 256 << 20
THRESHOLD = 0.3


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal settings: learning rate, its damping, L1, L2, passes over the sample, bits of the hash space."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    passes: int = 4
    bits: int = 22


@dataclass
class ToxicityModel:
    """Sparse weights; ``constant`` replaces them where a class has no labelled text."""

    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    bits: int = Rates.bits
    constant: float | None = None


# words are runs of letters, digits and bytes beyond ASCII; A-Z count as a-z
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _BREAK[_first : _last + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hashed feature of every word, neighbouring pair and pair with one word between."""
    data, places = utf8(texts)
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, places, _BREAK)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    rows, codes = [row], [mix(h)]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            codes.append(mix(h[:-gap][same] * np.uint64(factor) + h[gap:][same]))
    return np.concatenate(rows), (np.concatenate(codes) >> np.uint64(64 - bits)).astype(np.int64)


def text_codes(texts: pa.Array, rates: Rates) -> list[np.ndarray]:
    """The features of each text, each once, the constant last."""
    out = []
    for k in range(len(texts)):
        _, code = hashed_features(texts.slice(k, 1), rates.bits)
        out.append(np.append(np.unique(code), 1 << rates.bits).astype(np.int32))
    return out


def _learn(rows: list[np.ndarray], labels: np.ndarray, rates: Rates) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the texts' features in turn: feature, weight, and the weight of the constant."""
    z = np.zeros((1 << rates.bits) + 1, np.float32)
    n = np.zeros((1 << rates.bits) + 1, np.float32)
    constant = 1 << rates.bits

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == constant, 0.0, rates.l1)
        return np.where(
            np.abs(z[at]) <= l1,
            0.0,
            -(z[at] - np.sign(z[at]) * l1) / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2),
        )

    for _ in range(rates.passes):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rates.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    used = np.flatnonzero(np.abs(z[:-1]) > rates.l1)
    return used, weights(used), float(weights(np.array([constant]))[0])


def fit(
    docs: DataFrame, labels: DataFrame, held_out=None, rows: int = SAMPLE_ROWS, rates: Rates | None = None
) -> ToxicityModel:
    """Learn from at most ``rows`` labelled texts per class, and ``SAMPLE_BYTES`` of text.

    ``held_out`` is a condition on ``doc_id`` that keeps rows from being learned; by default crc32 of the id, modulo
    4, is 2. Rows with null or other labels are not used. All texts are learned in turn at every size, whole; the task
    holds their features, not the texts. The class sizes behind the sample correct the constant.
    """
    ship_by_value()
    rates = rates or Rates()
    held_out = crc_remainder(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    sample = labelled_sample(docs, labels, "toxic", held_out, rows, SAMPLE_BYTES)
    if not sample.usable:
        return ToxicityModel(constant=sample.prior, bits=rates.bits)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, marks = [], []
        for batch in batches:
            for part in text_slices(batch):
                codes += text_codes(part.column("text"), rates)
                marks += part.column("label").to_pylist()
        if codes:
            y = np.array(marks, float)
            at, weight, bias = _learn(codes, y, rates)
            odds = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, [-1, -2])), pa.array(np.append(weight, [bias, odds]).astype(float))], ["at", "weight"]
            )

    chosen = sample.docs.select("text", "label", "place").repartition(1).sortWithinPartitions("place", "text")
    got = chosen.mapInArrow(learn, "at long, weight double").toPandas()
    if not len(got):
        return ToxicityModel(constant=sample.prior, bits=rates.bits)
    learned = dict(zip(got["at"], got["weight"], strict=True))
    bias, odds = learned.pop(-1), learned.pop(-2)
    bias += np.log(sample.sizes[1] / sample.sizes[0]) - odds
    index = np.array(sorted(learned), np.int64)
    return ToxicityModel(index, np.array([learned[k] for k in index], np.float32), float(bias), rates.bits)


def with_score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` and the probability that its ``text`` is toxic (null: as the empty text)."""

    def values():
        if model.constant is not None:
            return lambda texts: np.full(len(texts), model.constant)
        dense = np.zeros(1 << model.bits, np.float32)
        dense[model.index] = model.weight

        def of(texts: pa.Array) -> np.ndarray:
            row, code = hashed_features(texts, model.bits)
            counts = dense[code] != 0
            seen = np.unique((row[counts] << model.bits) | code[counts])  # a feature counts once per text
            weight = dense[seen & ((1 << model.bits) - 1)]
            margin = np.bincount(seen >> model.bits, weight, minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(margin + model.bias, -30, 30)))

        return of

    return with_column(docs, name, values)


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Empty and null texts get the score of the constant alone; repeated rows get equal scores; without labelled texts
    of both classes every score is the share of label 1 (a half without any label).
    """
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = with_score(chosen, fit(docs, labels, rows=rows))
    return out.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
