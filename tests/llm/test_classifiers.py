import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import language, quality, toxicity

DOCS = "doc_id long, text string, lang string, score double, label int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Good texts of invented words, bad ones full of marks; a few words make a text toxic."""
    rng = random.Random(11)
    parts = ["ka", "lo", "mi", "ter", "ven", "ost", "ria"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rng.randint(40, 120))]
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["Vile!", "rotten", "filth,"])
        text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "##", "%%"]) for w in words)
        docs.append((i, text, "xx", 0.0, 0))
        labels.append((i, int(good), int(toxic)))
    docs += [(9000, None, None, 0.0, 0), (9001, "", "xx", 0.0, 0), (None, "ka lo", None, 0.0, 0), (5, docs[5][1], "xx", 0.0, 0)]
    labels += [(3, None, None), (None, 1, 1), (4, 1, 7)]
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)


def accuracy(result, labels, name):
    truth = {r["doc_id"]: r[name] for r in labels.collect() if r["doc_id"] is not None and r[name] in (0, 1)}
    held = [r for r in result if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 700]
    assert len(held) > 80
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


@pytest.mark.parametrize(("module", "name", "modulus", "rest"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(corpus, module, name, modulus, rest):
    docs, labels = corpus
    result = module.classify(docs, labels).collect()
    assert len(result) == docs.count() and accuracy(result, labels, name) > 0.95
    for r in result:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
    twice = {r["score"] for r in result if r["doc_id"] == 5}
    assert len(twice) == 1 and len({r["score"] for r in result if r["doc_id"] in (9000, 9001)}) == 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_rows(corpus, module, spark):
    docs, labels = corpus
    name = "quality" if module is quality else "toxic"
    none = module.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = module.classify(docs, labels.where(f"{name} = 1")).collect()
    assert {r["score"] for r in ones} == {1.0}
    assert module.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_held_out_rows_are_not_learned(corpus):
    docs, labels = corpus
    turned = labels.selectExpr(
        "doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic"
    )
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.classify(docs, x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_language(spark):
    rng = random.Random(3)
    sounds = {"aa": ["sha", "dor", "lin", "wek"], "bb": ["sho", "der", "lan", "wik", "ñu"], "cc": ["qui", "eau", "ment"]}
    rows = []
    for i in range(600):
        name = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[name]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 60)))
        rows.append((i, text, name, 0.0, 0))
    rows += [(700, None, "aa", 0.0, 0), (701, "", None, 0.0, 0), (702, "123 ... 45", "bb", 0.0, 0), (703, "漢字", None, 0.0, 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    held = [r for r in rows if r[0] < 600 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == name for i, _, name, _, _ in held) > 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (700, 701, 702)] == ["und"] * 3
    assert got[703]["lang_pred"] in sounds and got[703]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_more_languages_than_one_mask_holds(spark):
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x0561, 0x0587)] + [chr(c) for c in range(0x10D0, 0x10F0)] + [chr(c) for c in range(0x0430, 0x0450)]
    rows = []
    for k in range(150):
        own = rng.sample(letters, 9)
        for i in range(12):
            text = " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 6))) for _ in range(30))
            rows.append((100 * k + i, text, f"l{k}", 0.0, 0))
    rows.append((99000, "qq ww", " ", 0.0, 0))  # a blank name is a name
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = language.fit(docs)
    assert len(model.names) > 128 and len(model.masks) == 3
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(got) == len(rows) and sum(got[r[0]] == r[2] for r in held) > 0.95 * len(held)


def test_toxicity_learns_a_large_sample_as_one(spark):
    rng = random.Random(7)
    words = ["ka", "lo", "mi", "ter", "ven", "ost", "ria", "dor"]
    docs = [(i, " ".join(rng.choices(words, k=5) + ["vile"] * (i % 3 == 0 and i % 5 > 0)), "xx", 0.0, 0) for i in range(15000)]
    labels = [(i, 1, int(i % 3 == 0)) for i, *_ in docs]
    docs, labels = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    got = toxicity.fit(docs, labels, rates=toxicity.Rates(bits=16))
    sample = toxicity.labelled_sample(docs, labels, "toxic", toxicity.crc_remainder(toxicity.F.col("doc_id"), 4) == 2, toxicity.SAMPLE_ROWS)
    rows = sample.docs.select("text", "label", "place").toPandas()
    assert len(rows) > 9000
    rows = rows.sort_values(["place", "text"], kind="stable")
    codes = toxicity.text_codes(pa.array(rows["text"]), toxicity.Rates(bits=16))
    at, weight, _ = toxicity._learn(codes, rows["label"].to_numpy(float), toxicity.Rates(bits=16))
    assert got.index.tolist() == at.tolist() and np.allclose(got.weight, weight)


def test_sample_has_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(200)] + [(7, None)] + [(3, f"copy {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(20)], "doc_id long, toxic int")
    held_out = toxicity.F.lit(False)
    a, b = (sorted(map(tuple, toxicity.labelled_sample(docs.repartition(n), labels, "toxic", held_out, 50).docs.select("doc_id", "text", "label").collect())) for n in (2, 5))
    assert a == b and [r[0] for r in a] == list(range(20))


def test_sample_is_bounded_in_bytes_by_whole_texts(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * 1000) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(300)], "doc_id long, toxic int")
    def sample(most):
        return toxicity.labelled_sample(docs, labels, "toxic", toxicity.F.lit(False), 500, most).docs.collect()
    assert len(sample(None)) == len(sample(10**6)) == 300
    few = sample(100_000)
    for k in (0, 1):
        total = sum(len(r["text"]) for r in few if r["label"] == k)
        assert 0 < total <= 50_000 and all(len(r["text"]) > 1000 for r in few)
    assert sum(r["label"] for r in few) == 40
    assert sorted(r["label"] for r in sample(10)) == [0, 1]


def plain_ftrl(texts, labels, rates):
    """FTRL-proximal with dicts, feature by feature."""
    z, n = {}, {}

    def weight(k, l1):
        v = z.get(k, 0.0)
        if abs(v) <= l1:
            return 0.0
        return -(v - math.copysign(l1, v)) / ((rates.beta + math.sqrt(n.get(k, 0.0))) / rates.alpha + rates.l2)

    rows = [{int(c) for c in toxicity.hashed_features(pa.array([t]), rates.bits)[1]} | {"bias"} for t in texts]
    for _ in range(rates.passes):
        for row, y in zip(rows, labels):
            w = {k: weight(k, 0.0 if k == "bias" else rates.l1) for k in row}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
            for k in row:
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / rates.alpha * w[k]
                n[k] = before + g * g
    return {k: weight(k, rates.l1) for k in z if k != "bias" and abs(z[k]) > rates.l1}, weight("bias", 0.0)


def test_ftrl_against_plain_updates():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ka", "lo", "mi", "vile", "dor"], k=rng.randint(1, 9))) for _ in range(300)]
    labels = [int("vile" in t) for t in texts]
    rates = toxicity.Rates(bits=12, l1=1.0)
    at, weight, bias = toxicity._learn(toxicity.text_codes(pa.array(texts), rates), np.array(labels, float), rates)
    expected, constant = plain_ftrl(texts, labels, rates)
    assert set(at.tolist()) == set(expected) and len(expected) > 3
    assert bias == pytest.approx(constant, rel=1e-3)
    assert weight.tolist() == pytest.approx([expected[int(k)] for k in at], rel=1e-3)


def test_the_curve_learns_from_whole_texts(spark):
    """Long good texts that repeat a block at their end are good; their middle alone would not show it."""
    rng = random.Random(4)
    def words(n):
        return " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 7))) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        good = i % 2
        text = words(2500) + " tail" * 900 * (i % 4 > 1) if good else "! ".join(words(6).upper() for _ in range(300))
        docs.append((i, text))
        labels.append((i, good))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    real = quality._text_features
    model = quality.fit(docs, labels)
    compress = quality._compressors(model)
    for r in docs.where("doc_id < 8").collect():
        seen.append(real(pa.array([r["text"]]), compress)[0])
    points = {(p["a"], p["b"], p["c"]) for p in quality._curve_points(quality.labelled_sample(docs, labels, "quality", quality.F.lit(False), 4000).docs, model.good, model.bad)}
    assert all(tuple(x) in points for x in seen)  # what the curve sees of a text is what scoring sees
    result = quality.classify(docs, labels).collect()
    held = [r for r in result if r["held_out"]]
    assert all(r["predicted"] == r["doc_id"] % 2 for r in held) and len(held) > 50


def test_words_of_languages_against_plain_sets(spark):
    """Per language the n-grams found in the bit-sliced filters, against exact sets."""
    rng = random.Random(8)
    sounds = {"aa": ["sha", "dor", "lin"], "bb": ["sho", "der", "lan"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[n]) for _ in range(3)) for _ in range(20)), n, 0.0, 0) for i in range(200) for n in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    grams = {n: set() for n in sounds}
    for i, text, name, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            grams[name] |= {text[k : k + 4] for k in range(len(text) - 3)}
    for i, text, name, _, _ in rows:
        own = {text[k : k + 4] for k in range(len(text) - 3)}
        best = max(sounds, key=lambda n: len(own & grams[n]))
        assert got[i]["lang_pred"] == best == name
