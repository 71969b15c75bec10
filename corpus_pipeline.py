"""A training corpus from raw documents: quality, toxicity, near-duplicates, repeated passages, packed sequences.

Each stage takes the documents that its predecessor kept, as a stored table, and all but the last return documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import packing, quality, simhash, substrings, toxicity
from tablescope.llm.common import free_names, materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def _kept(docs: DataFrame, with_score, model, keep) -> DataFrame:
    """The rows whose score passes, under whatever columns they have."""
    (name,) = free_names(docs, "score")
    return with_score(docs, model, name).where(keep(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good.

    Null and empty texts are judged like the empty text; repeated rows all stay or all go. An empty table stays empty;
    without labels of both classes the share of good labels decides for all.
    """
    model = quality.fit(docs, _labels(spark, sf_dir))
    return _kept(docs, quality.with_score, model, lambda score: score >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not take for toxic.

    Null and empty texts are judged like the empty text; repeated rows all stay or all go. An empty table stays empty;
    without labels of both classes the share of toxic labels decides for all.
    """
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return _kept(docs, toxicity.with_score, model, lambda score: score < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null last.

    Null, empty and wordless texts are one group; of rows equal in id and text one stays; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand more than once; ``n_chars`` follows the text.

    Null and empty texts stay as they are, repeated rows stay without what they repeat, an empty table stays empty.
    """
    kept = substrings.remove(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens.

    Null and empty texts are a piece of the end token alone, repeated rows are packed as often as they come, an empty
    table has no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: Classifiers, tokenizers and fingerprints are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of each is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
