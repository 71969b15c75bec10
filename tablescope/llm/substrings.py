"""Exact substring dedup over words by recompression.

1. Every text is recompressed in its task. Each window of ``width`` words names one symbol inside it (see
   ``window_symbols``); neighbouring windows that name the same symbol are a unit. One row per unit is shuffled by the
   symbol's key and a hash of all words of the unit.
2. Units of equal key and content are repeats in full. Where units of one key differ, some of their windows may still
   be equal; only these windows are compared one by one. Contents and windows are compared by the XXH3 digest of their
   words themselves, 128 bits; keys and names only bring candidates together.
3. The words that repeated windows cover are removed.

A task sends one row per key and content at most, whatever the number of copies it has read, so no key and content
gather more rows than there are tasks. A key alone may have any number of contents: its contents are only counted, and
where they are many, the few keys of that kind are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import (
    free_names,
    materialize,
    mix,
    ship_by_value,
    text_key,
    text_slices,
    utf8,
    word_line,
    word_names,
)
from tablescope.llm.recompression import window_symbols

WIDTH = 35
ROUNDS = 3
#: Rows that a task holds back to combine equal ones.
COMBINED_ROWS = 1 << 19
#: Contents of a key beyond which its rows are not shuffled by the key.
HOT_KEY = 1 << 16

_REPEATED, _UNSURE, _WITNESS = 2, 1, 3  # a unit that repeats; one to compare by window; one that repeats and is compared with


class _Words:
    """Words, windows and units of a slice of texts."""

    def __init__(self, texts: pa.Array, width: int, rounds: int):
        self.data, _, self.starts, self.ends, self.first = word_line(texts)
        count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), count)
        names = word_names(self.data, self.starts, self.ends)
        last = np.repeat(self.first[1:], count)
        self.windows = np.flatnonzero(np.arange(len(names)) + width <= last)
        self.key, place = window_symbols(names, self.text, self.windows, width, rounds)
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 0) | (np.diff(self.windows) != 1)
        self.unit = np.flatnonzero(new)  # number of a unit's first window
        self.unit_end = np.append(self.unit[1:], len(place)) if len(place) else self.unit
        self.unit_first, self.unit_last = self.windows[self.unit], self.windows[self.unit_end - 1] + width
        self.unit_place = place[self.unit]
        self.unit_text = self.text[self.unit_first]
        self.unit_start = self.unit_first - self.first[self.unit_text]  # counted from the text's first word

    def digests(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digest of the words from ``a`` to ``b``, one space between them."""
        line, digest = memoryview(self.data.tobytes()), xxhash.xxh3_128_digest
        spans = zip(self.starts[a].tolist(), self.ends[b - 1].tolist(), strict=True)
        made = np.frombuffer(b"".join([digest(line[x:y]) for x, y in spans]), np.uint64).reshape(-1, 2)
        return made[:, 0], made[:, 1]

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """What identifies the units: their words, and where in them the symbol stands."""
        first, second = self.digests(self.unit_first, self.unit_last)
        offset = np.where(self.unit_place >= 0, self.unit_place - self.unit_first, 0).astype(np.uint64)
        return first ^ mix(offset), second


def _combined(rows: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*rows, strict=True)]


def _units(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """``key, content, content2, ref, start, n``: units to compare (n: 1, or 2 for one that stands for several of the task), and
    with n = 0 units that are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            key, content, content2, ref, start = _combined(rows)
            order = np.lexsort((content2, content, key))
            key, content, content2, ref, start = (x[order] for x in (key, content, content2, ref, start))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (content2[1:] != content2[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(key)))
            n = np.zeros(len(key), np.int32)
            n[new] = np.minimum(size, 2)
            # known repeats only pass through the shuffle: they are spread by their own place
            spread = mix(ref.view(np.uint64) + start.astype(np.uint64))
            key = np.where(n == 0, spread, key)
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x.view(np.int64)) for x in (key, content, content2)),
                    *(pa.array(x) for x in (ref, start, n)),
                ],
                ["key", "content", "content2", "ref", "start", "n"],
            )

        rows: list[tuple] = []
        for batch in batches:
            for part in text_slices(batch):
                w = _Words(part.column("text"), width, rounds)
                ref = part.column("ref").to_numpy(zero_copy_only=False)
                rows.append((w.key[w.unit], *w.contents(), ref[w.unit_text], w.unit_start.astype(np.int32)))
                if sum(len(r[0]) for r in rows) >= COMBINED_ROWS:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return docs.select("ref", "text").mapInArrow(
        run, "key long, content long, content2 long, ref long, start int, n int"
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first ``keys`` columns, cut so that no group is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        same = np.ones(whole.num_rows, bool)
        for c in whole.columns[:keys]:
            values = c.to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        cut = whole.num_rows - int(same.sum())
        if cut:
            yield [c.to_numpy(zero_copy_only=False) for c in whole.slice(0, cut).columns]
        held = [whole.slice(cut)]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield [c.to_numpy(zero_copy_only=False) for c in whole.columns]


def _compared(units: DataFrame) -> DataFrame:
    """``ref, code``: 4 * start + what is known about the unit there, for units that share their key with others.

    Rows meet by key and content; of these groups one row each asks whether its key has other contents. Such keys are
    counted with a combinable aggregate, and no task gathers the rows of a key that more than ``HOT_KEY`` contents share.
    A unit that repeats and is a witness has a row of either code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, content, content2, ref, start, n in whole_groups(batches, 3):
            new = np.arange(len(key)) == 0
            for x in (key, content, content2, n == 0):
                new[1:] |= x[1:] != x[:-1]
            total = np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]
            state = np.where((n == 0) | (total >= 2), _REPEATED, 0)
            asks = new & (n > 0)
            code = start.astype(np.int64) * 4 + state
            known = asks | (state > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[known]) for x in (key, ref, code, asks)], ["key", "ref", "code", "asks"]
            )

    rows = units.repartition("key", "content", "content2").sortWithinPartitions("key", "content", "content2", "n")
    rows = materialize(rows.mapInArrow(run, "key long, ref long, code long, asks boolean"))
    asking = rows.where("asks").select("key", "ref", "code")
    mixed = materialize(asking.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1"))
    # few keys can be hot: their number is at most that of all units by HOT_KEY
    hot = F.broadcast(mixed.where(F.col("contents") > HOT_KEY).select("key"))
    others = mixed.where(F.col("contents") <= HOT_KEY).select("key")
    found = asking.join(hot, "key").unionByName(asking.join(hot, "key", "left_anti").join(others, "key"))
    # _UNSURE and _WITNESS follow 0 and _REPEATED
    found = found.select("ref", (F.col("code") + 1).alias("code"))
    return rows.where(F.col("code") % 4 == _REPEATED).select("ref", "code").unionByName(found)


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """``ref, ref2, text``, each text once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column("ref").to_pylist(), batch.column("ref2").to_pylist(), strict=True))
            take = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    take.append(k)
            yield batch.take(pa.array(take, pa.int64()))

    return docs.select("ref", "ref2", "text").mapInArrow(run, "ref long, ref2 long, text string")


def _unit_windows(w: _Words, codes: list, states: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows of all units in one of the states, and each one's state."""
    first = np.concatenate([[0], np.cumsum(np.bincount(w.unit_text, minlength=len(codes)))]).astype(np.int64)
    numbers, found = [], []
    for t, text_codes in enumerate(codes):
        code = np.array(text_codes, np.int64)
        code = code[np.isin(code % 4, states)]
        if not len(code):
            continue
        at = first[t] + np.searchsorted(w.unit_start[first[t] : first[t + 1]], code // 4)
        size = w.unit_end[at] - w.unit[at]
        numbers.append(np.repeat(w.unit[at] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()))
        found.append(np.repeat(code % 4, size))
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.concatenate(found)


def _single_windows(flagged: DataFrame, width: int, rounds: int) -> DataFrame:
    """``first, second, ref, ref2, start, n`` of windows to compare, the digest of their words in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            first, second, ref, ref2, start, unsure = _combined(rows)
            order = np.lexsort((second, first))
            first, second, ref, ref2, start, unsure = (x[order] for x in (first, second, ref, ref2, start, unsure))
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(first)))[np.cumsum(new) - 1]
            # n: 1 or 2 rows behind it, plus 4 if the window's own fate is open; 8: known to repeat
            n = np.where(new, np.minimum(size, 2) + 4 * unsure, np.where(unsure, 8, 0))
            n[(size >= 2) & new & unsure] = 2 + 4
            keep = n > 0
            spread = mix(ref.view(np.uint64) + start.astype(np.uint64))
            first = np.where(n == 8, spread, first)
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x[keep].view(np.int64)) for x in (first, second)),
                    *(pa.array(x[keep]) for x in (ref, ref2, start, n.astype(np.int32))),
                ],
                ["first", "second", "ref", "ref2", "start", "n"],
            )

        rows: list[tuple] = []
        for batch in batches:
            for part in text_slices(batch):
                w = _Words(part.column("text"), width, rounds)
                number, state = _unit_windows(w, part.column("codes").to_pylist(), (_UNSURE, _WITNESS))
                at = w.windows[number]
                text = w.text[at]
                ref, ref2 = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("ref", "ref2"))
                start = (at - w.first[text]).astype(np.int32)
                rows.append((*w.digests(at, at + width), ref, ref2, start, state == _UNSURE))
                if sum(len(r[0]) for r in rows) >= COMBINED_ROWS:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return flagged.select("ref", "text", "ref2", "codes").mapInArrow(
        run, "first long, second long, ref long, ref2 long, start int, n int"
    )


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """``ref, ref2, start`` of compared windows that also stand elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, second, ref, ref2, start, n in whole_groups(batches, 2):
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            rows = np.where(n == 8, 0, n % 4)
            total = np.add.reduceat(rows, np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = (n == 8) | ((n >= 4) & (total >= 2))
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (ref, ref2, start)], ["ref", "ref2", "start"])

    rows = windows.repartition("first", "second").sortWithinPartitions("first", "second")
    return rows.mapInArrow(run, "ref long, ref2 long, start int")


def _kept(flagged: DataFrame, width: int, rounds: int) -> DataFrame:
    """``ref, ref2, n_removed, kept``: the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                w = _Words(part.column("text"), width, rounds)
                number, _ = _unit_windows(w, part.column("codes").to_pylist(), (_REPEATED, _WITNESS))
                begin = [w.windows[number]]
                for t, starts in enumerate(part.column("starts").to_pylist()):
                    if starts:
                        begin.append(np.array(starts, np.int64) + w.first[t])
                begin = np.concatenate(begin)
                n = len(w.starts)
                cover = np.bincount(begin, minlength=n + 1) - np.bincount(
                    np.minimum(begin + width, n), minlength=n + 1
                )
                gone = np.cumsum(cover)[:n] > 0
                raw = w.data.tobytes()
                removed, kept = [], []
                for t in range(part.num_rows):
                    a, b = w.first[t], w.first[t + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    removed.append(int(b - a - len(stay)))
                    kept.append(
                        b" ".join(
                            [raw[x:y] for x, y in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]
                        ).decode()
                    )
                yield pa.RecordBatch.from_arrays(
                    [part.column("ref"), part.column("ref2"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["ref", "ref2", "n_removed", "kept"],
                )

    return flagged.select("ref", "text", "ref2", "codes", "starts").mapInArrow(
        run, "ref long, ref2 long, n_removed long, kept string"
    )


def repeated_texts(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``ref, ref2, n_removed, kept`` of every different text that loses words (see ``text_key``)."""
    ship_by_value()
    texts = docs.select(*text_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    codes = _compared(_units(texts, width, rounds)).groupBy("ref").agg(F.collect_set("code").alias("codes"))
    codes = materialize(codes)
    flagged = _distinct_texts(texts).join(codes, "ref").groupBy("ref", "ref2")
    flagged = materialize(flagged.agg(F.first("text").alias("text"), F.first("codes").alias("codes")))
    found = _repeated_windows(_single_windows(flagged, width, rounds))
    found = materialize(found.groupBy("ref", "ref2").agg(F.collect_set("start").alias("starts")))
    kept = _kept(flagged.join(found, ["ref", "ref2"], "left"), width, rounds)
    return materialize(kept.where(F.col("n_removed") > 0))


def digest(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    A text of fewer than ``width`` words loses nothing. Null and empty texts have no word and the digest of the empty
    text. Rows with equal texts repeat one another. Repeats within one text count.
    """
    ship_by_value()
    found = repeated_texts(docs, width, rounds).select(
        "ref", "ref2", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("less")
    )
    chosen = docs.select("doc_id", *text_key(), F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = utf8(batch.column("text"))
            raw = data.tobytes()
            words = [raw[a:b].split() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            count = pa.array([len(x) for x in words], pa.int64())
            whole = pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in words], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], count, whole], ["doc_id", "ref", "ref2", "n_words", "whole"])

    all_ = chosen.mapInArrow(run, f"doc_id {kind}, ref long, ref2 long, n_words long, whole string")
    return all_.join(found, ["ref", "ref2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("less", "whole").alias("kept_sha256"),
    )


def remove(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; a text that loses nothing stays as it is.

    Null and empty texts stay null and empty. Repeated rows all stay, each without its repeated words. Columns of any
    name are kept as they are.
    """
    names = free_names(docs, "ref", "ref2", "kept")
    found = repeated_texts(docs, width, rounds).select("ref", "ref2", "kept").toDF(*names)
    keyed = docs.withColumns(dict(zip(names, text_key(), strict=False)))
    joined = keyed.join(found, names[:2], "left")
    text = F.coalesce(F.col(names[2]), F.col("text").cast("string"))
    shown = [text.cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*shown)
