import math
import random
import re

import numpy as np
import pytest

from tablescope.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_definition(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scored = []
        for doc_id, words in held:
            m = 100 - 90 + (90 * len(words) * n) // total
            score = 0
            for t in set(terms(text)):
                tf = words.count(t)
                if tf:
                    df = sum(t in w for _, w in held)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        out += [(item, rank, d, s) for rank, (_, _, d, s) in enumerate(sorted(scored, key=lambda r: r[:2] + (r[2] or 0,))[:k], 1)]
    return out


def tables(seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "漢字", "don't", "A-b", "x_y", "1.5"]
    docs = [" ".join(rng.choice(words[: rng.choice([5, 67])]) for _ in range(rng.choice([1, 4, 30, 90]))) for _ in range(150)]
    docs = [*docs, *docs[:30], *["w1 w2"] * 25, None, "", " .,- ", "W3 " * 4000]
    items = [" ".join(rng.sample(words, rng.choice([1, 5, 40]))) for _ in range(12)] + [None, "", "nowhere", " ".join(words * 2)]
    return [(i // 2 if i % 7 else i, t) for i, t in enumerate(docs)], [(i % 14, t) for i, t in enumerate(items)]


def rows_of(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("block", [ranked_search.BLOCK_ITEMS, 5])
def test_ranks_equal_those_by_definition(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        docs, items = tables()
        left = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
        right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
        assert rows_of(ranked_search.search(left, right)) == sorted(by_definition(docs, items))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_are_left_only_when_they_cannot_reach_the_last_place():
    rng = np.random.default_rng(8)
    for _ in range(60):
        counts = rng.integers(0, 4, (rng.integers(1, 12), rng.integers(1, 300))) * rng.integers(0, 2, (1, 1))
        counts[rng.random(counts.shape) < 0.6] = 0
        weights = rng.integers(0, 9000, len(counts))
        norm = rng.integers(10, 400, counts.shape[1])
        score = np.array([sum(int(w) * (10**9 * int(c) // (1000 * int(c) + 8 * int(m))) for w, c in zip(weights, col) if c) for col, m in zip(counts.T, norm)])
        found, got = ranked_search.best_documents(weights, counts, norm, 10, 0)
        assert (score[found] == got).all()
        last = max(sorted(score.tolist(), reverse=True)[:10][-1], 1) if len(score) >= 10 else 1
        assert set(np.flatnonzero(score >= last)) == set(found.tolist())


def test_text_ids_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "sea"), ("a", "sea"), (None, "sea"), ("c", "land")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "Sea")], "item_id string, text string")
    assert [(r["rank"], r["doc_id"]) for r in ranked_search.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_length_norm_beyond_64_bits():
    n = np.array([10**7, 3], np.int64)
    assert ranked_search.length_norm(n, 5 * 10**10, 10**13).tolist() == [10 + 90 * x * 5 * 10**10 // 10**13 for x in n.tolist()]
