import numpy as np
import pytest
import xxhash

from tablescope.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Brute force: doc_id -> smallest reachable doc_id."""
    ids = list(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def texts():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        w = base[k % 4].split()
        w[int(rng.integers(len(w)))] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    return [*rows, (200, None), (201, ""), (202, " \t\n"), (203, "ONE two"), (204, "one TWO"), (205, base[0])]


def test_groups_are_those_of_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, bits int, vertex int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df.repartition(3)).collect()}
    prints = {i: plain(t) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == components(prints)
    kept = simhash.one_of_each(df.unionAll(df))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(prints).values()))
    assert kept.columns == df.columns


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_links_of_a_dense_group(spark, chunk):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    values = {centre}
    for _ in range(150):
        v = centre
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long"), chunk=chunk).collect()
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in found:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
        parent[root(a)] = root(b)
    unsigned = {v: v & ((1 << 64) - 1) for v in signed}
    expected = components(unsigned)
    assert len({root(v) for v in signed}) == len(set(expected.values()))


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (7, "a b"), (None, "c d e")], schema)).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["7", "7", "None"]
    assert simhash.one_of_each(spark.createDataFrame([(None, "a b"), (7, "a b"), (None, "c d e")], schema)).count() == 2


def test_blocks_lose_no_link():
    for n in (6, 7, 9):
        masks = [m & ((1 << 64) - 1) for m in simhash.block_masks(n)]
        rng = np.random.default_rng(n)
        for _ in range(200):
            difference = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(difference & m == 0 for m in masks)
