import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tablescope.llm import packing, reuse, token_counts, transducer
from tablescope.llm.common import utf8

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "Bc", "Word.", "'s", "'t", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "é", "漢", "😀", "1", "²", ".", "!!",
         "<|endoftext|>", "<|", " ", " ", "_", "'", "İ,", "ß", "Σ.", "ﬁ", "क़,", "word, "]


def odd_texts(n=400):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 6, 60]))) for _ in range(n)]
    return [*texts, "x" * 5000, "long word " * 3000, " ".join(texts[:50])]


def compiled(most_states=transducer.MOST_STATES):
    return transducer.Transducer(BYTES, transducer.character_classes(BYTES), most_states)


def slices(texts, step):
    for k in range(0, len(texts), step):
        yield texts[k : k + step], utf8(pa.array(texts[k : k + step], pa.string()))


def test_machines_give_the_tokenizer_s_ids_and_counts():
    # few states: what was compiled is forgotten again and again
    machine, whole = compiled(most_states=200), Tokenizer.from_file(BYTES)
    for part, (data, places) in slices([None, *odd_texts(), "'re" * 700, " \n" * 900, "<|endoftext|>" * 3], 50):
        expected = [whole.encode(t or "", add_special_tokens=False).ids for t in part]
        ids, at = machine.ids(data, places)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == expected
        assert machine.counts(data, places).tolist() == [len(e) for e in expected]


def test_long_texts_are_read_in_windows(monkeypatch):
    monkeypatch.setattr(transducer, "WINDOW", 300)
    machine, whole = compiled(), Tokenizer.from_file(BYTES)
    for text in ["".join(odd_texts(120)), "é" * 4000, " " * 3000 + "x", "ab " * 500 + "<|endoftext|>" * 200, "a" * 3000]:
        ids = whole.encode(text, add_special_tokens=False).ids
        data, places = utf8(pa.array([text]))
        assert machine.counts(data, places).tolist() == [len(ids)]
        assert machine.ids(data, places)[0].tolist() == ids


def test_maps_of_chunks_compose_to_reading_in_one_go():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 12, 5000).astype(np.uint8)
    one = transducer.cut_marks(kinds, lane=5000)
    for lane in (1, 2, 7, 128):
        assert (transducer.cut_marks(kinds, lane=lane) == one).all()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        transducer.Transducer(WORDS, transducer.character_classes(WORDS))


def test_token_counts(spark):
    whole = Tokenizer.from_file(BYTES)
    texts = [None, "", "one", "one", "word " * 700, *odd_texts(60)]
    df = spark.createDataFrame([(i % 40, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    expected = sorted((i % 40, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    rows = token_counts.token_counts(df, BYTES).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows) and any(r["over_limit"] for r in rows)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0
    named = spark.createDataFrame([(None, "a"), ("x", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(named, BYTES).collect()} == {(None, 1), ("x", 0)}


@pytest.mark.parametrize("limits", [packing.Limits(64), packing.Limits(64, documents=3), packing.Limits(64, attention=64**2 // 2 * 2, rule="dot"),
                                    packing.Limits(64, documents=5, attention=4500, weights=(1, 1, 1), rule="dot")])
def test_plan_keeps_every_limit(limits):
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 65, 3000), return_counts=True)
    used: dict[int, list[tuple[int, int]]] = {}
    placed = dict.fromkeys(lengths.tolist(), 0)
    for length, first, count, per_bin, start, offset in packing.plan_bins(lengths, counts, limits).tolist():
        assert first == placed[length]
        placed[length] += count
        for k in range(count):
            used.setdefault(start + k // per_bin, []).append((offset + k % per_bin * length, length))
    assert placed == dict(zip(lengths.tolist(), counts.tolist()))
    tokens_, documents, attention = limits.capacities()
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]]
        assert sum(n for _, n in pieces) <= tokens_ and len(pieces) <= documents
        assert sum(n * n for _, n in pieces) <= attention
    if limits.documents is None and limits.attention is None:
        assert len(used) <= 1.01 * int((lengths * counts).sum()) / 64 + 1  # bins cannot all be full


def test_packing(spark):
    whole = Tokenizer.from_file(BYTES)
    texts = [None, "", "short", "word " * 5000, *odd_texts(40), "word " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, task int").repartition(3)
    rows = packing.pack(df, BYTES).collect()
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]]
        assert sum(n for _, n in pieces) <= 2048
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 2048 for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def test_chunks_join_to_the_tokenizer_s_ids(monkeypatch):
    monkeypatch.setattr(reuse, "MEAN_BYTES", 32)
    monkeypatch.setattr(reuse, "MOST_BYTES", 300)
    monkeypatch.setattr(reuse, "MEMORY_WORDS", 300)
    encoder = reuse.ChunkEncoder(WORDS)
    texts = odd_texts()
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        assert encoder.encode(pa.array(part)) == [encoder.whole(t) for t in part]


def test_encoding(spark):
    whole = Tokenizer.from_file(WORDS)
    shared = "Some passage that many texts share, word by word. " * 200
    texts = [None, "", "  ", shared + "a", "b " + shared, shared, *odd_texts(30)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    assert reuse.shared_chunks(df, WORDS, 5)
    for r in reuse.encoded(df, WORDS, 5, with_text=True).collect():
        ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["decoded"] == text and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert reuse.encoded(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
