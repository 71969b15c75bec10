"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts texts into chunks, so that shared passages give equal chunks wherever they stand.
A chunk is encoded once, but for the words that its ends cut through: where two chunks join, the word between the last
white space before and the first white space behind is encoded anew. White space always ends a token of this
vocabulary, so the ids beyond it agree with those of the whole text.

The chunks that occur most often in all documents are encoded once on the cluster and broadcast (a bounded number);
any other chunk is encoded once per task. Sending every chunk through a shuffle to be encoded once would move the whole
text and all its ids, which costs more than it saves.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescope.llm.common import ship_by_value, text_key, text_slices, utf8

#: Mean bytes between cuts, most bytes of a chunk, and bytes that the rolling hash looks at; powers of two.
MEAN_BYTES = 1024
MOST_BYTES = 16384
LOOK_BYTES = 32
#: Chunks that are broadcast; they hold at most ``SHARED_CHUNKS * MOST_BYTES`` bytes of text.
SHARED_CHUNKS = 2048
#: What one task remembers: words of one generation (there are two), and bytes of encoded chunks.
MEMORY_WORDS = 200_000
MEMORY_BYTES = 48 << 20

# white space on which libraries differ, and characters that may be taken for it
_ODD = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")
# marks that begin a token of their own behind a letter or digit
_TAIL = ".,;:!?|#*%$&"
#: Words that are encoded as one string, and the mark between them.
_LINE_WORDS = 500
_MARK = "|"
_FACTOR = 0x9E3779B1


def cuts_of(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ends of the chunks: where the hash of the last bytes says so, at ends of texts, and after ``MOST_BYTES``."""
    n = len(data)
    # polynomial hash of the last LOOK_BYTES bytes by doubling: that of 2k bytes is made of those of k bytes
    hashes = data.astype(np.uint32) + np.uint32(1)
    k, factor = 1, _FACTOR
    while k < LOOK_BYTES:
        hashes[k:] += hashes[:-k] * np.uint32(factor)
        k, factor = 2 * k, factor * factor & 0xFFFFFFFF
    cut = (hashes * np.uint32(_FACTOR)) >> np.uint32(33 - MEAN_BYTES.bit_length()) == 0
    # a text's first bytes see the text before; there is no cut among them
    for k in range(LOOK_BYTES):
        at = places[:-1] + k
        cut[at[at < np.minimum(places[1:], n)]] = False
    ends = np.flatnonzero(cut) + 1
    # not within a character
    while len(ends):
        inside = (ends < n) & ((data[np.minimum(ends, n - 1)] & 0xC0) == 0x80)
        if not inside.any():
            break
        ends = ends + inside
    ends = np.unique(np.concatenate([ends, places]))
    gaps = np.diff(ends)
    if len(gaps) and gaps.max() > MOST_BYTES:
        more = []
        for start, gap in zip(ends[:-1][gaps > MOST_BYTES].tolist(), gaps[gaps > MOST_BYTES].tolist(), strict=True):
            at = start + MOST_BYTES
            while at < start + gap:
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                more.append(at)
                at += MOST_BYTES
        ends = np.unique(np.concatenate([ends, more]))
    return ends


def chunks_of(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All bytes, the ends of all chunks (0 in front), and for each text the number of its first chunk (and one more)."""
    data, places = utf8(texts)
    ends = cuts_of(data, places)
    return data.tobytes(), ends, np.searchsorted(ends, places)


def _key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class ChunkEncoder:
    """Ids and decoded text of whole texts, chunk by chunk."""

    def __init__(self, path: str, shared: dict[bytes, tuple] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.shared = shared or {}
        self.chunks: dict[bytes, tuple] = {}
        self.held = 0

    def _result(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.tokens[i] for i in ids])

    def whole(self, text: str) -> tuple[bytes, str]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False)

    def _encode_words(self, words: list[str]) -> None:
        """Encode words, many as one string: white space ends a token, so the mark between two is an id of its own."""
        plain = [] if self.mark is None else [w for w in words if _MARK not in w]
        lines = [plain[k : k + _LINE_WORDS] for k in range(0, len(plain), _LINE_WORDS)]
        for k in range(0, len(lines), 16):
            texts = [f" {_MARK} ".join([*line, ""]) for line in lines[k : k + 16]]
            made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for line, encoding in zip(lines[k : k + 16], made, strict=True):
                ids = encoding.ids
                packed = np.array(ids, "<u4")
                ends = np.flatnonzero(packed == self.mark).tolist()
                raw, names = packed.tobytes(), [self.tokens[i] for i in ids]
                begin = 0
                for word, end in zip(line, ends, strict=True):
                    self.words[word] = raw[4 * begin : 4 * end], " ".join(names[begin:end])
                    begin = end + 1
        rest = words if self.mark is None else [w for w in words if _MARK in w]
        made = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        self.words.update(zip(rest, (self._result(e.ids) for e in made), strict=True))

    def _unknown(self, words: set[str]) -> set[str]:
        """Words that neither generation knows; those of the older one move to the younger."""
        new = words - self.words.keys()
        known = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in known)
        return new - known

    def learn(self, words: set[str]) -> None:
        """Encode new words. A word with stops behind it is the word's ids and those of the stops; case is lost anyway."""
        if len(self.words) + len(words - self.words.keys()) > MEMORY_WORDS:
            self.words, self.older = {}, self.words
        parts = []
        for w in self._unknown(words):
            base = w.rstrip(_TAIL)
            if len(base) != len(w):
                last = base[-1:].lower()  # two characters for some letters, of which the second is a mark
                if len(last) != 1 or last > "\u024f" or not last.isalnum():
                    base = w
            parts.append((w, base.lower() if base.isascii() else base, w[len(base) :]))
        self._encode_words(sorted(self._unknown({p for _, base, tail in parts for p in (base, tail) if p})))
        for w, base, tail in parts:
            ids, decoded = self.words[base]
            if tail:
                ids, decoded = ids + self.words[tail][0], f"{decoded} {self.words[tail][1]}"
            self.words[w] = ids, decoded

    def _joined(self, words: list[str]) -> tuple[bytes, str]:
        got = [self.words[w] for w in words]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def records(self, chunks: dict[bytes, str]) -> dict[bytes, tuple]:
        """For each chunk: the part of a word in front, ids and decoded text of the words inside, the part behind.

        A chunk without white space is one part of a word: (text, None, None, None).
        """
        split = {}
        for key, text in chunks.items():
            words = text.split()
            if not words:
                split[key] = ("", [], "") if text else (text, None, None)
                continue
            head = words.pop(0) if not text[0].isspace() else ""
            if not words and head == text:
                split[key] = (text, None, None)
                continue
            tail = words.pop() if words and not text[-1].isspace() else ""
            split[key] = (head, words, tail)
        self.learn({w for _, words, _ in split.values() for w in words or ()})
        return {k: (h, None, None, None) if w is None else (h, *self._joined(w), t) for k, (h, w, t) in split.items()}

    def encode(self, texts: pa.Array) -> list[tuple[bytes, str]]:
        """Ids, as little-endian unsigned 32-bit numbers, and decoded text of each text."""
        raw, ends, first = chunks_of(texts)
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        keys = [_key(raw[a:b]) for a, b in spans]
        odd = [bool(_ODD.search(t)) or any(s in t for s in self.special) for t in texts.fill_null("").to_pylist()]
        new = {}
        for t, strange in enumerate(odd):
            for c in range(first[t], first[t + 1]) if not strange else ():
                if keys[c] not in self.shared and keys[c] not in self.chunks:
                    new[keys[c]] = raw[spans[c][0] : spans[c][1]].decode()
        made = self.records(new)
        known = {k: self.shared.get(k) or self.chunks.get(k) or made[k] for k in keys if k in self.shared or k in self.chunks or k in made}
        # the words that cuts go through
        joints: list[list] = []
        for t, strange in enumerate(odd):
            parts: list = []
            open_ = ""
            for c in range(first[t], first[t + 1]) if not strange else ():
                head, ids, decoded, tail = known[keys[c]]
                open_ += head
                if ids is None:
                    continue
                if open_:
                    parts.append(open_)
                if ids:
                    parts.append((ids, decoded))
                open_ = tail
            if open_:
                parts.append(open_)
            joints.append(parts)
        self.learn({p for parts in joints for p in parts if isinstance(p, str)})
        out = []
        for t, parts in enumerate(joints):
            if odd[t]:
                out.append(self.whole(raw[ends[first[t]] : ends[first[t + 1]]].decode()))
                continue
            got = [self.words[p] if isinstance(p, str) else p for p in parts]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        self.held += sum(len(r[1] or b"") * 3 + 200 for r in made.values())
        if self.held > MEMORY_BYTES:
            self.chunks, self.held = {}, 0
        else:
            self.chunks.update(made)
        return out


def shared_chunks(docs: DataFrame, vocabulary: str, most: int = SHARED_CHUNKS) -> dict[bytes, tuple]:
    """The ``most`` chunks that occur most often, encoded: counts over all documents, texts of the chosen ones only."""
    ship_by_value()
    texts = docs.select(text_key()[0], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def keys_of(part: pa.RecordBatch) -> Iterator[tuple[bytes, int, bytes]]:
        raw, ends, first = chunks_of(part.column("text"))
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        for t, ref in enumerate(part.column("ref").to_pylist()):
            for a, b in spans[first[t] : first[t + 1]]:
                chunk = raw[a:b]
                yield _key(chunk), ref, chunk

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict[bytes, int], refs: dict[bytes, int]) -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([refs[k] for k in seen], pa.int64())], ["key", "n", "ref"])

        seen: dict[bytes, int] = {}
        refs: dict[bytes, int] = {}
        for batch in batches:
            for part in text_slices(batch):
                for key, ref, _ in keys_of(part):
                    seen[key] = seen.get(key, 0) + 1
                    refs[key] = ref
            if len(seen) > 1 << 19:
                yield out(seen, refs)
                seen, refs = {}, {}
        yield out(seen, refs)

    counted = texts.mapInArrow(count, "key binary, n long, ref long").groupBy("key")
    counted = counted.agg(F.sum("n").alias("n"), F.min("ref").alias("ref"))
    often = counted.where(F.col("n") > 1).orderBy(F.desc("n"), "key").limit(most).select("key", "ref").collect()
    chosen = {bytes(r["key"]) for r in often}
    if not chosen:
        return {}
    holders = sorted({r["ref"] for r in often})  # texts that hold the chosen chunks: no more than there are chunks

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, str] = {}
        done: set[int] = set()
        for batch in batches:
            for part in text_slices(batch):
                refs = part.column("ref").to_pylist()
                new = [k for k, ref in enumerate(refs) if ref not in done]
                done.update(refs)
                for key, _, chunk in keys_of(part.take(pa.array(new, pa.int64()))):
                    if key in chosen and key not in found:
                        found[key] = chunk.decode()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], ["key", "chunk"]
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = ChunkEncoder(vocabulary)
        for batch in batches:
            made = encoder.records(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            columns = zip(*((k, *r) for k, r in made.items()), strict=True) if made else [[]] * 5
            kinds = [pa.binary(), pa.string(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "head", "ids", "decoded", "tail"]
            )

    held = texts.where(F.col("ref").isin(holders)).mapInArrow(fetch, "key binary, chunk string")
    once = held.groupBy("key").agg(F.min("chunk").alias("chunk"))
    made = once.mapInArrow(encode, "key binary, head string, ids binary, decoded string, tail string").collect()
    return {
        bytes(r["key"]): (r["head"], None if r["ids"] is None else bytes(r["ids"]), r["decoded"], r["tail"]) for r in made
    }


def encoded(docs: DataFrame, vocabulary: str, most: int = SHARED_CHUNKS, with_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and with ``with_text`` also ``ids, decoded``.

    Null counts as empty; the empty text has no token and the digests of nothing. Texts that hold the string of a
    special token, or white space that libraries judge differently, are encoded whole. Repeated rows repeat.
    """
    ship_by_value()
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, vocabulary, most))
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = ChunkEncoder(vocabulary, shared.value)
        for batch in batches:
            for part in text_slices(batch):
                got = [(ids, text.encode()) for ids, text in encoder.encode(part.column("text"))]
                columns = [
                    part.column("doc_id"),
                    pa.array([len(ids) // 4 for ids, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in got], pa.string()),
                    pa.array([hashlib.sha256(text).hexdigest() for _, text in got], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    ids = [np.frombuffer(i, "<u4").astype(np.int64) for i, _ in got]
                    columns += [pa.array(ids, pa.list_(pa.int64())), pa.array([t.decode() for _, t in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<long>, decoded string" if with_text else ""
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
