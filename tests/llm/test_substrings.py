import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablescope.llm import substrings
from tablescope.llm.common import mix, word_line, word_names


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def mixed(seed, n=120):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        w = []
        while len(w) < rng.choice([2, 20, 70, 160]):
            pick = rng.random()
            if texts and pick < 0.3:
                other = rng.choice(texts).split()
                at = rng.randrange(len(other) or 1)
                w += other[at : at + rng.randint(1, 60)]
            elif pick < 0.45:
                w += [rng.choice("ab")] * rng.randint(1, 50)
            elif pick < 0.55:
                w += list(rng.choice(["ab", "abc", "abca"])) * rng.randint(1, 20)
            else:
                w.append(rng.choice("abcdefgh"))
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    return [*texts, None, "", "  ", texts[3], texts[3], "é漢 " * 50]


@pytest.mark.parametrize(("seed", "width", "rounds"), [(1, 35, 3), (2, 6, 3), (3, 9, 1), (4, 35, 5)])
def test_windows_are_those_of_brute_force(spark, seed, width, rounds):
    texts = mixed(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ref int")
    got = substrings.digest(df.repartition(4), width, rounds).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, width)


def test_small_tasks_and_removal(spark, monkeypatch):
    monkeypatch.setattr(substrings, "COMBINED_ROWS", 5)
    texts = mixed(9, 60)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    cleaned = substrings.remove(df.repartition(3)).orderBy("doc_id")
    assert cleaned.columns == df.columns
    for r, text, (_, removed, digest) in zip(cleaned.collect(), texts, brute(texts, 35)):
        if removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest
        else:
            assert r["text"] == text


def test_empty_table(spark):
    assert substrings.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_key_of_many_contents_is_not_gathered(spark, monkeypatch):
    gather = substrings.whole_groups

    def bounded(batches, keys):
        for columns in gather(batches, keys):
            _, size = np.unique(np.stack([c.view(np.uint64) for c in columns[:keys]]), axis=1, return_counts=True)
            assert size.max() <= 4, f"{size.max()} rows of a group in one task"
            yield columns

    monkeypatch.setattr(substrings, "whole_groups", bounded)
    monkeypatch.setattr(substrings, "HOT_KEY", 20, raising=False)
    rng = random.Random(4)
    phrase = [f"line{i}" for i in range(30)]  # shorter than a window
    texts = [" ".join([*(f"a{rng.random()}" for _ in range(40)), *phrase, *(f"b{rng.random()}" for _ in range(40))]) for _ in range(200)]
    texts += [texts[0] + " end", "start " + texts[1], texts[2], texts[2] + " x y z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = substrings.digest(df).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, 35)


def alternating(flip, n):
    """Letters by the parity of the bits of the place: sums with powers of an odd base cancel between both patterns."""
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


@pytest.mark.parametrize("size", [8, 64, 1024, 4096])
def test_words_that_cancel_in_sums_are_told_apart(spark, size):
    common = [f"w{k}" for k in range(30)]
    texts = [" ".join([*common, alternating(flip, size), *common[::-1][:29]]) for flip in (0, 1)]
    texts += [" ".join(["x", *common, alternating(0, size), "tail", "words", "of", "it", "y"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substrings.digest(df).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, 35)
    assert [r["n_removed"] for r in got] == [0, 0, 0]


def test_names_do_not_decide(spark, monkeypatch):
    """Even if all words had one of four names, the words themselves are compared."""
    import tablescope.llm.substrings as module

    monkeypatch.setattr(module, "word_names", lambda data, a, b: mix((b - a).astype(np.uint64) % np.uint64(4)))
    texts = mixed(12, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = substrings.digest(df, 9, 2).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, 9)


def test_word_names():
    rng = random.Random(3)
    words = {bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 300))) for _ in range(3000)}
    words |= {alternating(f, n).encode() for f in (0, 1) for n in (8, 16, 1024, 2048)}
    first = sorted(words)
    import pyarrow as pa

    names = {}
    for order in (first, first[::-1]):
        data, _, a, b, _ = word_line(pa.array([b" ".join(order).decode()]))
        for word, name in zip(order, word_names(data, a, b).tolist()):
            assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(words)


def test_a_long_text(spark):
    rng = random.Random(6)
    words = [f"v{rng.randrange(4000)}" for _ in range(250_000)]
    words[200_000:200_060] = words[100:160]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[150_000:150_034])), (3, " ".join(words[150_000:150_035]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.digest(df).collect()}
    assert got == {1: 60 + 60 + 35, 2: 0, 3: 35}
