import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from tablescope.llm import quality, simhash, toxicity  # noqa: E402
from tablescope.plans.storage import materialize  # noqa: E402

from tests.llm.test_near_duplicates import components, plain  # noqa: E402
from tests.llm.test_substrings import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
def test_stages_against_brute_force(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(materialize(stage(spark, made[-1], DATA)))
    assert all(m.columns == docs.columns for m in made[:-1])
    ids = [{r["doc_id"] for r in m.select("doc_id").collect()} for m in made]
    good = quality.classify(made[0], labels).where("predicted = 1")
    assert ids[1] == {r["doc_id"] for r in good.collect()}
    clean = toxicity.classify(made[1], labels).where("predicted = 0")
    assert ids[2] == {r["doc_id"] for r in clean.collect()}
    texts = {r["doc_id"]: r["text"] for r in made[2].collect()}
    assert ids[3] == set(components({i: plain(t) for i, t in texts.items()}).values())
    before = made[3].orderBy("doc_id").collect()
    after = made[4].orderBy("doc_id").collect()
    for old, new, (_, removed, digest) in zip(before, after, brute([r["text"] for r in before], 35), strict=True):
        kept = hashlib.sha256(b" ".join((new["text"] or "").encode().split())).hexdigest()
        assert kept == digest and (removed or new["text"] == old["text"])
        assert new["n_chars"] == len(new["text"])
    assert ids[5] == ids[4] and made[5].where("length > 2048 OR offset + length > 2048").count() == 0
    assert simhash.near_duplicates(made[3]).where("doc_id <> component_id").count() == 0


CLASHES = ["_score", "score", "_ref", "_ref2", "ref", "REF2", "_number", "number", "kept", "_kept_text", "_ref_of_text", "place", "label"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with columns whose names the stages might use themselves, some odd rows, and labels."""
    folder = tmp_path_factory.mktemp("tables")
    source = spark.read.parquet(f"{DATA}/documents.parquet").limit(150)
    odd = spark.createDataFrame([(9001, None, None, None, 0), (9002, "", "xx", "s", 0), (None, "no id at all", "xx", "s", 12)], source.schema)
    docs = source.unionByName(odd).unionByName(source.limit(3))
    for k, name in enumerate(CLASHES):
        if name.lower() not in {c.lower() for c in docs.columns}:
            docs = docs.withColumn(name, docs["doc_id"] * 0 + k)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
def test_clashing_columns_keep_their_values(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    given = {tuple(r) for r in docs.select(rest).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = materialize(stage(spark, docs, small))
        assert made.columns == docs.columns, name
        assert {tuple(r) for r in made.select(rest).collect()} <= given, name
        docs = made
    assert docs.count() > 50
    assert stage_of("packing")(spark, docs, small).count() >= docs.count()


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
def test_empty_tables_through_all_stages(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
