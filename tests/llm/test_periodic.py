import hashlib
import random

import numpy as np
import pytest

from tablescope.llm import periodic


def plain_runs(words):
    """Every maximal run, by definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            part = words[start : start + length]
            smallest = next(p for p in range(1, q + 1) if part[p:] == part[:-p])
            if smallest == q and length >= max(6, 4 * q):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "a b c " * 4 + "a", "word " * 900]
    for _ in range(250):
        words = [rng.choice("ab" if rng.random() < 0.3 else "abcdefghij") for _ in range(rng.choice([6, 9, 30, 200]))]
        for _ in range(rng.choice([0, 1, 3])):
            at, p = rng.randrange(len(words)), rng.choice([1, 2, 3, 4, 5, 7, 8, 12, 16, 31, 33])
            unit = [rng.choice("abcdefgh") for _ in range(p)]
            words[at:at] = (unit * 9)[: p * 4 + rng.randrange(-2, 2 * p + 3)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words) + rng.choice(["", " ", "\n\n"]))
    long_unit = [f"w{k}" for k in range(700)]
    texts.append(" ".join(["x"] * 50 + long_unit * 5 + long_unit[:33] + ["y"] * 50 + ["é", "漢"] * 400))
    return texts


@pytest.mark.parametrize("group", [1, 3, periodic.GROUP])
def test_runs_equal_those_by_definition(spark, monkeypatch, group):
    monkeypatch.setattr(periodic, "GROUP", group)
    monkeypatch.setattr(periodic, "BATCH_WORDS", 500)
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(3)
    rows = {r["doc_id"]: r for r in periodic.spans(df).collect()}
    kept = {r["doc_id"]: r["text"] for r in periodic.collapsed(df).collect()}
    assert len(rows) == len(kept) == len(texts)
    found = 0
    for i, text in enumerate(texts):
        words = (text or "").split()
        expected = plain_runs(words)
        found += len(expected)
        assert [(r["start"], r["length"], r["period"]) for r in rows[i]["runs"]] == expected, i
        assert rows[i]["n_words"] == len(words)
        gone = {k for a, n, q in expected for k in range(a + q, a + n)}
        assert kept[i] == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert found > 200


def test_digest_of_edited_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["on", "the", "sea", "is", "calm", f"x{k}"]) for k in range(rng.choice([1, 3, 40, 120]))) for _ in range(300)]
    texts += [None, "", "a " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    edited = 0
    for r in periodic.digest(df).collect():
        words = (texts[r["doc_id"]] or "").split()
        order = periodic.repeated_tail(r["doc_id"], len(words))
        edited += order is not None
        words = words if order is None else [words[k] for k in order]
        runs = plain_runs(words) if len(words) < 1000 else [(0, 2000, 1)]
        assert r["n_runs"] == len(runs)
        if runs:
            a, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (a, n, q, 1000 * n // q)
        else:
            assert r["start"] is None and r["exponent_milli"] is None
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert edited > 10


def test_ids_of_any_type_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x " * 8), ("a", "x " * 8), (None, "x " * 8), ("b", None)], "doc_id string, text string")
    rows = periodic.spans(df).collect()
    assert sorted((r["doc_id"] or "", len(r["runs"])) for r in rows) == [("", 1), ("a", 1), ("a", 1), ("b", 0)]
    assert periodic.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_z_function():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.integers(0, 2, rng.integers(0, 40)).tolist()
        expected = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s) == expected
