"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases, each the shortest that was not seen before in the text. The phrases are hashed, and the
smallest hashes are the fingerprint; two fingerprints compare like the phrase sets, which compare like compression.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import mix, ship_by_value

#: Hashes in a fingerprint, 8 hex digits each.
KEPT = 128
#: Runs of neighbouring documents per shuffle partition.
RUNS_PER_PARTITION = 8

_CHAR_BITS = 21
_CHAR_MASK = (1 << _CHAR_BITS) - 1
_WORD = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15


class PhraseParser:
    """The phrases of a text as a tree that can be grown, and cut back to an earlier state."""

    def __init__(self):
        self.tree: dict[int, int] = {}  # (phrase, character) -> longer phrase; phrases are numbered times 2^21
        self.hashes = [1]
        self.at = 0

    def grow(self, text: str) -> None:
        tree, hashes, at = self.tree, self.hashes, self.at
        find, add = tree.get, hashes.append
        size = len(hashes) << _CHAR_BITS
        for c in np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist():
            longer = find(at | c)
            if longer is None:
                tree[at | c] = size
                add((hashes[at >> _CHAR_BITS] * _FACTOR + c) & _WORD)
                size += 1 << _CHAR_BITS
                at = 0
            else:
                at = longer
        self.at = at

    def state(self) -> tuple[int, int]:
        return len(self.tree), self.at

    def back_to(self, state: tuple[int, int]) -> None:
        size, self.at = state
        for _ in range(len(self.tree) - size):
            self.tree.popitem()
        del self.hashes[size + 1 :]

    def fingerprint(self, kept: int = KEPT) -> np.ndarray:
        """The smallest hashes of the phrase set, ascending."""
        h = np.unique((mix(np.array(self.hashes[1:], np.uint64)) >> np.uint64(32)).astype(np.uint32))
        return h[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of common phrases: of the smallest hashes of both together, those that both hold."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:kept]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


#: Rows of the sample from which the ends of a run are taken.
_SAMPLED_PER_RUN = 64


def _order_key(doc_id, text_hash: int) -> tuple:
    """Ascending key of the order whose reverse is that of the documents: null ids first, ids, hashes of the texts."""
    return doc_id is not None, doc_id.encode() if isinstance(doc_id, str) else 0 if doc_id is None else doc_id, text_hash


def _cuts(keyed: DataFrame, runs: int) -> list[tuple]:
    """Keys of documents at which runs begin, evenly by rows: from a sample of distinct keys with their counts."""
    total = keyed.count()
    share = min(1.0, _SAMPLED_PER_RUN * runs / max(total, 1))
    drawn = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    # a bounded number of rows: about _SAMPLED_PER_RUN to a run, however often a key is repeated
    rows = keyed.where(drawn).groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted((_order_key(r["doc_id"], r["hash"]), r["n"]) for r in rows)
    step = sum(n for _, n in ordered) / runs
    cuts, reached = [], 0.0
    for key, n in ordered:
        if reached >= len(cuts) * step:
            cuts.append(key)
        reached += n
    return cuts


def _runs(docs: DataFrame) -> DataFrame:
    """``run, guest, lap, doc_id, hash, text``: neighbours in the order of documents share a run, and a run ends with its
    next document as guest.

    Documents are ordered by ``doc_id``, descending, null last, and equal ids by the hash of their texts, so that an id
    that many texts share is cut like any other. Runs begin at documents of a sample, a fixed number per shuffle
    partition; only these documents are copied. The order is a circle: the run of the last documents goes on with the
    first ones, in a second lap.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))
    cuts = _cuts(keyed.select("doc_id", "hash"), RUNS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    names = ["run", "guest", "lap", "doc_id", "hash", "text"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, run, guest, lap = [], [], [], []
            for k, (doc_id, hash_) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), strict=True)):
                key = _order_key(doc_id, hash_)
                # in the order of documents a run goes down from its cut to above the next smaller one
                own = bisect.bisect_left(cuts, key)
                over = own == len(cuts)  # above all cuts: the first documents, which follow the last ones
                at.append(k)
                run.append(0 if over else own)
                guest.append(0)
                lap.append(int(over))
                if not over and cuts[own] == key:  # begins a run: the guest of the run before
                    at.append(k)
                    run.append((own + 1) % len(cuts))
                    guest.append(1)
                    lap.append(1)
            rows = batch.take(pa.array(at, pa.int64()))
            added = [pa.array(c, pa.int32()) for c in (run, guest, lap)]
            yield pa.RecordBatch.from_arrays([*added, *rows.columns], names)

    return keyed.mapInArrow(place, f"run int, guest int, lap int, doc_id {kind}, hash long, text string")


def fingerprints(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has its last ``n_chars // 2`` characters replaced by the first as many (or all) of the next
    document, in descending ``doc_id`` (null last, equal ids by the XXH64 of their texts, descending); after the last
    comes the first, so a single row is its own next. Ids may be of any type that sorts. Null counts as empty. The empty text has no phrase and an empty fingerprint, which is like another
    empty one (1) and unlike any other (0). Equal texts have equal fingerprints.
    """
    ship_by_value()
    order = ["run", "guest", "lap", F.desc_nulls_last("doc_id"), F.desc("hash")]
    rows = _runs(docs).repartition("run").sortWithinPartitions(*order)
    rows = rows.select("run", "guest", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def plain(text: str) -> np.ndarray:
        parser = PhraseParser()
        parser.grow(text)
        return parser.fingerprint(kept)

    def both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
        """Fingerprints of a text and of its edited text, which share the parse of the first half, and the latter."""
        half = len(text) // 2
        head, tail = text[: len(text) - half], text[len(text) - half :]
        parser = PhraseParser()
        parser.grow(head)
        state = parser.state()
        parser.grow(tail)
        own = parser.fingerprint(kept)
        parser.back_to(state)
        parser.grow(following[:half])
        return own, parser.fingerprint(kept), head + following[:half]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def finish(row: tuple, following: np.ndarray) -> None:
            doc_id, text, own, changed, edited = row
            out.append(
                (
                    doc_id,
                    len(text),
                    hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    as_text(own),
                    as_text(changed),
                    likeness(own, changed, kept),
                    likeness(own, following, kept),
                )
            )

        def made() -> pa.RecordBatch:
            types = [batch_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            columns = zip(*out, strict=True) if out else [()] * len(names)
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return got

        batch_type = None
        current = None  # number of the run
        opening = None  # its first text
        waiting = None  # (doc_id, text) whose next document has not come yet
        done = None  # a finished row that waits for its next document's fingerprint
        closed = False

        def follow(text: str) -> None:
            """The waiting document has its next text; the one before has its next fingerprint."""
            nonlocal done, waiting
            row = (*waiting, *both(waiting[1], text))
            if done is not None:
                finish(done, row[2])
            done, waiting = row, None

        def close(text: str) -> None:
            nonlocal done, closed
            if waiting is not None:
                follow(text)
                finish(done, plain(text))
            done, closed = None, True

        for batch in batches:
            batch_type = batch.column("doc_id").type
            for run_, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run_ != current:
                    if current is not None and not closed:
                        close(opening)
                    current, opening, waiting, done, closed = run_, text, None, None, False
                if guest:
                    if not closed:
                        close(text)
                    continue
                if waiting is not None:
                    follow(text)
                waiting = (doc_id, text)
                if len(out) >= 256:
                    yield made()
        if current is not None and not closed:
            close(opening)
        if batch_type is not None:
            yield made()

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
