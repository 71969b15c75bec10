"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import (
    exact_search,
    language,
    packing,
    periodic,
    phrases,
    quality,
    ranked_search,
    reuse,
    simhash,
    substrings,
    token_counts,
    toxicity,
    wrapper,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _query(build):
    QUERIES[build.__name__] = build
    return build


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"))


@_query
def op3_quality_compression(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_search.search(_table(spark, folder, "embeddings"))


ORACLES["op4_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


@_query
def op5_phrase_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.fingerprints(_table(spark, folder, "documents"))


@_query
def op6_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.extract(_table(spark, folder, "pages"))


@_query
def op7_language_bitmask(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


@_query
def op8_chunk_reuse(spark: SparkSession, folder: str) -> DataFrame:
    return reuse.encoded(_table(spark, folder, "documents"), _vocabulary("word_bpe_49k.json"))


@_query
def op9_recompression(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(_table(spark, folder, "documents"))


@_query
def op10_toxicity_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op11_presence_masks(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


_TERMS = r"""regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op11_presence_masks"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), n AS (
  SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n
), q AS (
  SELECT i, item_id, unnest(list_distinct(terms)) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)
), x AS (
  SELECT r, unnest(terms) AS term FROM d
), tf AS (
  SELECT r, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs
), scored AS (
  SELECT i, item_id, r, n.doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r), total
  GROUP BY i, item_id, r, n.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""


@_query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(_table(spark, folder, "documents"))


@_query
def op13_token_transducer(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"))
