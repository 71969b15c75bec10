"""Language by bit-sliced Bloom filters: one bit per language behind each hashed n-gram.

An n-gram belongs to a language when its share among the language's n-grams reaches a bound and is not small beside
its share in the language that uses it most. The filter is an array of language masks for every 64 languages; the AND
of an n-gram's masks names all languages that contain it, and each language's count of hits, less the expected false
ones, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import crc_remainder, materialize, mix, ship_by_value, text_slices

UNDECIDED = "und"
#: Characters of an n-gram; least share of a language's n-grams; least part of the largest share; filter size; hashes.
GRAMS = (2, 3, 4)
LEAST_SHARE = 2e-5
LEAST_PART = 0.34
FILTER_BITS = 20
HASHES = 2
#: Languages of one mask: more languages take more masks for each place.
MASK_LANGUAGES = 64
#: N-grams that a task counts before it sends them on.
COUNTED = 1 << 23


@dataclass
class LanguageModel:
    """Names of the languages, the masks by 64 languages and place, and each language's share of set bits."""

    names: list[str] = field(default_factory=list)
    masks: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << FILTER_BITS), np.uint64))
    filled: np.ndarray = field(default_factory=lambda: np.zeros(0))


_SPACE_CODE = np.uint32(32)


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and 64-bit code of each n-gram, and which rows have a letter.

    Texts are lower-cased; runs of anything but letters become one space, so that n-grams see where words begin and
    end but neither digits nor marks.
    """
    joined = "\n".join(" " if t is None else t.lower().replace("\n", " ") for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, back = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in known], bool)[back]
    end = code == 10
    row = np.cumsum(end) - end
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    code = np.where(letter, code, _SPACE_CODE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first mark behind a letter stands for all of them
    keep[0] = True
    code, row = code[keep].astype(np.uint64), row[keep]
    rows, codes = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        value = np.zeros(m, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x110000) + code[k : k + m]
        if n > 3:  # beyond 63 bits: a hash
            value = mix(value)
        value = (value << np.uint64(2)) | np.uint64(n - 2) if n <= 2 else mix(value + np.uint64(n))
        same = row[:m] == row[n - 1 :]
        rows.append(row[:m][same])
        codes.append(value[same])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), has
    return np.concatenate(rows), np.concatenate(codes), has


def _places(codes: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - FILTER_BITS)
    first = mix(codes)
    return [(mix(first + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> shift).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, learn=None) -> LanguageModel:
    """Count n-grams of all rows that may be learned and build the filter.

    ``learn`` is a condition on ``doc_id``; by default crc32 of the id, modulo 3, is not 1. Every language but
    null is learned, whatever their number. Counts are combined in each task before the shuffle; what comes back is at most
    ``1 / LEAST_SHARE`` n-grams per language and n, whatever the number of documents.
    """
    ship_by_value()
    learn = crc_remainder(F.col("doc_id"), 3) != 1 if learn is None else learn
    chosen = docs.where(learn).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(name: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            codes, n = merged(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"]
            )

        held = 0
        for batch in batches:
            for part in text_slices(batch, limit=1 << 19):
                langs = np.array(part.column("lang").to_pylist(), object)
                row, code, _ = grams_of(part.column("text").to_pylist())
                for name in dict.fromkeys(langs):
                    codes, n = np.unique(code[(langs == name)[row]], return_counts=True)
                    parts = kept.setdefault(name, [])
                    parts.append((codes, n))
                    held += len(codes)
                    if len(parts) >= 8:
                        kept[name] = [merged(parts)]
                        if len(kept[name][0][0]) > 1 << 20:  # a bound on the task's memory, not on what is counted
                            yield out(name, kept.pop(name))
                if held > COUNTED:  # many languages together: see what is held once equal n-grams are merged
                    kept = {name: [merged(parts)] for name, parts in kept.items()}
                    held = sum(len(parts[0][0]) for parts in kept.values())
                    if held > COUNTED // 2:
                        for name, parts in kept.items():
                            yield out(name, parts)
                        kept, held = {}, 0
        for name, parts in kept.items():
            yield out(name, parts)

    counts = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the shares need each language's total; both come from the one stored table of counts
    counts = materialize(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()
    if not totals:
        return LanguageModel()
    names = [r["lang"] for r in totals]
    known = counts.sparkSession.createDataFrame(
        [(r["lang"], k, float(r["total"])) for k, r in enumerate(totals)], "lang string, number int, total double"
    )
    often = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    rows = often.where(F.col("share") >= LEAST_SHARE).select("number", "code", "share").toPandas()
    rows = rows[rows["share"] >= LEAST_PART * rows.groupby("code")["share"].transform("max")]
    model = LanguageModel(names, np.zeros((-(-len(names) // MASK_LANGUAGES), 1 << FILTER_BITS), np.uint64))
    slab, bit = np.divmod(rows["number"].to_numpy(np.int64), MASK_LANGUAGES)
    bits = np.uint64(1) << bit.astype(np.uint64)
    for place in _places(rows["code"].to_numpy(np.int64).view(np.uint64)):
        np.bitwise_or.at(model.masks, (slab, place), bits)
    model.filled = np.array(
        [((model.masks[k // MASK_LANGUAGES] >> np.uint64(k % MASK_LANGUAGES)) & np.uint64(1)).mean() for k in range(len(names))]
    )
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` and 0 for a null text, one without letters, or no hit at all."""
    ship_by_value()
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    false_rate = model.filled**HASHES
    names = np.array([*model.names, UNDECIDED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 19):
                row, code, has = grams_of(part.column("text").to_pylist())
                places = _places(code)
                rows, n = part.num_rows, len(model.names)
                total = np.maximum(np.bincount(row, minlength=rows), 1)
                hits = np.zeros((rows, max(n, 1)))
                for slab, masks in enumerate(model.masks):
                    mask = masks[places[0]]
                    for place in places[1:]:
                        mask &= masks[place]
                    some = np.flatnonzero(mask)
                    mask, at = mask[some], row[some]
                    for k in range(slab * MASK_LANGUAGES, min((slab + 1) * MASK_LANGUAGES, n)):
                        bit = np.uint64(k % MASK_LANGUAGES)
                        seen = np.bincount(at[((mask >> bit) & np.uint64(1)).astype(bool)], minlength=rows)
                        hits[:, k] = np.maximum(seen - false_rate[k] * total, 0) / (1 - false_rate[k])
                best = hits.argmax(1)
                most = hits[np.arange(rows), best]
                decided = has & (most > 0) if n else np.zeros(rows, bool)
                score = np.where(decided, most / np.maximum(hits.sum(1), 1e-9), 0.0)
                # a text with letters but no known n-gram gets the commonest language with score 0
                pred = np.where(has & (n > 0), np.where(decided, best, 0), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(list(names[pred]), pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    ``und`` with score 0 where the text is null or has no letter; a text whose n-grams are all unknown gets the
    commonest learned language with score 0; without any learned language every text is ``und``. Ties go to the
    language with more n-grams. Repeated rows get equal results.
    """
    out = predict(docs, fit(docs))
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
