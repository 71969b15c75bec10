"""Semantic types, quality scores, domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import profile, semantics
from tablescope.operators.profile import DOMAIN_KEYWORDS
from tablescope.operators.semantics import ID_NAME_PARTS, ORDINAL_WORDS
from workload.registry import query, rounded, texts, with_messy

# Kinds of the columns of the tables profiled below.
MESSY = {
    "order_id": "whole", "customer_id": "whole", "revenue_txt": "text", "amount": "real", "priority": "text",
    "status": "text", "order_date_txt": "text", "sparse_col": "real", "constant_col": "whole",
}
CUSTOMER = {
    "c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_acctbal": "real", "c_mktsegment": "text",
}
DOCUMENTS = {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"}


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def profile_sql(table: str, kinds: dict[str, str]) -> str:
    """One row per column with the counts and the semantic type, written out rule by rule."""
    parts = []
    for name, kind in kinds.items():
        named = any(part in name.lower() for part in ID_NAME_PARTS)
        ratio = "CAST(u AS DOUBLE) / nullif(n - m, 0)"
        is_id = f"{ratio} >= 0.95 AND ({str(named).lower()} OR {ratio} = 1.0)"
        if kind == "text":
            rules = (
                f"WHEN words <= 12 AND ordinal >= 2 THEN 'ordinal' "
                f"WHEN {ratio} > 0.5 AND u > 50 AND len > 30 THEN 'text' "
                f"WHEN {ratio} > 0.5 AND u > 50 THEN 'mixed' ELSE 'categorical'"
            )
            extra = (
                f"count(DISTINCT lower({name})) AS lowered, count(DISTINCT trim(lower({name}))) AS words, "
                f"count(DISTINCT CASE WHEN trim(lower({name})) IN ({_quoted(ORDINAL_WORDS)}) "
                f"THEN trim(lower({name})) END) AS ordinal, avg(length({name})) AS len"
            )
        else:
            whole = str(kind == "whole").lower()
            rules = (
                f"WHEN {whole} AND m = 0 AND u <= 10 AND low >= 0 AND high - low <= 20 THEN 'ordinal' ELSE 'numeric'"
            )
            extra = f"0 AS lowered, min({name}) AS low, max({name}) AS high"
        parts.append(
            f"SELECT '{name}' AS \"column\", CASE WHEN u <= 1 THEN 'constant' WHEN u = 2 THEN 'binary' "
            f"WHEN {is_id} THEN 'id' {rules} END AS semantic_type, u AS n_unique, lowered AS n_lowered, "
            f"m AS n_missing, round(100.0 * m / n, 1) AS missing_pct, n AS n_rows "
            f"FROM (SELECT count(*) AS n, count(*) - count({name}) AS m, count(DISTINCT {name}) AS u, {extra} "
            f"FROM {table})"
        )
    return " UNION ALL ".join(parts)


def _types_sql(table: str, kinds: dict[str, str]) -> str:
    return f"SELECT \"column\", semantic_type FROM ({profile_sql(table, kinds)})"


@query(with_messy(_types_sql("messy_orders", MESSY)))
def infer_semantic_types(t):
    return semantics.infer_semantic_types(t.messy_orders)


@query(_types_sql("documents", DOCUMENTS))
def infer_semantic_types_of_texts(t):
    """Distinct counts over whole texts."""
    return semantics.infer_semantic_types(t.documents)


@query(_types_sql("customer", CUSTOMER) + " WHERE semantic_type = 'id'")
def looks_like_id(t):
    found = semantics.column_profile(t.customer).filter(semantics.looks_like_id() & (F.col("n_unique") > 2))
    return found.select("column", "semantic_type")


@query(
    f"""SELECT 'grade' AS "column", count(DISTINCT g) AS levels, true AS is_ordinal FROM (
        SELECT CASE WHEN p_size < 17 THEN 'Small ' WHEN p_size < 34 THEN 'medium' ELSE 'LARGE' END AS g FROM part)
        HAVING count(DISTINCT CASE WHEN lower(trim(g)) IN ({_quoted(ORDINAL_WORDS)}) THEN lower(trim(g)) END) >= 2"""
)
def looks_ordinal(t):
    graded = t.part.selectExpr(
        "CASE WHEN p_size < 17 THEN 'Small ' WHEN p_size < 34 THEN 'medium' ELSE 'LARGE' END AS grade"
    )
    found = semantics.column_profile(graded).filter(semantics.looks_ordinal())
    return found.select(
        "column", F.col("n_unique").alias("levels"), (F.col("semantic_type") == "ordinal").alias("is_ordinal")
    )


@query(with_messy(
    f"SELECT \"column\", semantic_type, n_unique, n_missing, missing_pct FROM ({profile_sql('messy_orders', MESSY)})"
))
def build_schema(t):
    return semantics.build_schema(t.messy_orders).drop("dtype", "samples")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", string_agg(v, ',' ORDER BY v) AS samples FROM "
        f"(SELECT DISTINCT {c} AS v FROM {table} ORDER BY v LIMIT 5)"
        for table, c in [("part", "p_name"), ("part", "p_brand"), ("part", "p_type")]
    )
)
def sample_values(t):
    found = semantics.build_schema(t.part.select("p_name", "p_brand", "p_type"))
    return texts(found.select("column", "samples"), "samples")


@query(with_messy(
    f"SELECT \"column\" FROM ({profile_sql('messy_orders', MESSY)}) WHERE semantic_type IN ('numeric', 'id')"
))
def columns_of_type(t):
    return semantics.columns_of_type(semantics.build_schema(t.messy_orders), "numeric", "id")


# --- quality ---------------------------------------------------------------------

_CELLS = " + ".join(f"count({c})" for c in MESSY)
_DISTINCT = "(SELECT count(*) FROM (SELECT DISTINCT * FROM messy_orders))"
_PENALTY = (
    "(SELECT sum(CASE WHEN semantic_type = 'mixed' THEN 1.0 "
    "WHEN semantic_type = 'categorical' AND n_unique > n_lowered THEN 0.3 ELSE 0.0 END) "
    f"FROM ({profile_sql('messy_orders', MESSY)}))"
)


@query(with_messy(f"SELECT round(100.0 * ({_CELLS}) / (9 * count(*)), 6) AS score FROM messy_orders"))
def completeness(t):
    return rounded(profile.completeness(t.messy_orders), 6)


@query(with_messy(f"SELECT round(100.0 * {_DISTINCT} / count(*), 6) AS score FROM messy_orders"))
def uniqueness(t):
    return rounded(profile.uniqueness(t.messy_orders), 6)


@query(with_messy(f"SELECT round(100.0 - 100.0 * {_PENALTY} / 9, 6) AS score"))
def consistency(t):
    return rounded(profile.consistency(t.messy_orders), 6)


@query("SELECT round(100.0 * (1 - CAST(sum(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / (2 * count(*))), 6) AS score FROM orders")
def validity(t):
    planted = t.orders.select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 10 = 0 THEN double('Infinity') ELSE o_totalprice END").alias("price"),
    )
    return rounded(profile.validity(planted), 6)


@query(with_messy(
    f"""WITH parts AS (
      SELECT count(*) AS rows, round(100.0 * ({_CELLS}) / (9 * count(*)), 1) AS completeness,
             round(100.0 * {_DISTINCT} / count(*), 1) AS uniqueness,
             round(100.0 - 100.0 * {_PENALTY} / 9, 1) AS consistency, 100.0 AS validity,
             count(*) - {_DISTINCT} AS duplicate_rows FROM messy_orders),
    cols AS (SELECT count(CASE WHEN semantic_type = 'constant' THEN 1 END) AS constant_columns,
             count(CASE WHEN n_unique > 100 THEN 1 END) AS high_cardinality_columns
             FROM ({profile_sql('messy_orders', MESSY)}))
    SELECT rows, CAST(9 AS BIGINT) AS columns, duplicate_rows, constant_columns, high_cardinality_columns,
           CAST(5 AS BIGINT) AS numeric_columns, CAST(4 AS BIGINT) AS categorical_columns,
           CAST(0 AS BIGINT) AS datetime_columns, CAST(completeness AS DOUBLE) AS completeness,
           CAST(uniqueness AS DOUBLE) AS uniqueness, CAST(consistency AS DOUBLE) AS consistency,
           CAST(validity AS DOUBLE) AS validity,
           CAST(round(0.4 * completeness + 0.2 * uniqueness + 0.2 * consistency + 0.2 * validity, 1) AS DOUBLE) AS overall
    FROM parts, cols"""
))
def profile_dataset(t):
    return profile.profile_dataset(t.messy_orders)


_KEYWORDS = ", ".join(
    f"({rank}, '{domain}', '{word}', '{word.replace('_', ' ')}')"
    for rank, (domain, bank) in enumerate(DOMAIN_KEYWORDS.items())
    for word in bank
)


@query(
    f"""WITH names AS (
      SELECT doc_id, unnest(string_split(text, ' ')) AS name FROM documents),
    sizes AS (SELECT doc_id, count(*) AS columns FROM names GROUP BY doc_id),
    hits AS (
      SELECT doc_id, rank, domain, count(DISTINCT word) AS hits
      FROM (SELECT DISTINCT doc_id, replace(lower(name), '_', ' ') AS name FROM names) n
      JOIN (VALUES {_KEYWORDS}) k(rank, domain, word, needle) ON contains(n.name, k.needle)
      GROUP BY doc_id, rank, domain),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rank) AS place FROM hits)
    SELECT CAST(s.doc_id AS VARCHAR) AS "table", coalesce(b.domain, 'Generic') AS domain,
           CAST(round(least(1.0, coalesce(b.hits, 0) / greatest(s.columns * 0.3, 1.0)), 2) AS DOUBLE) AS confidence,
           coalesce(b.hits, 0) AS hits, r.domain AS runner_up
    FROM sizes s LEFT JOIN ranked b ON b.doc_id = s.doc_id AND b.place = 1
                 LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.place = 2"""
)
def domain_scores(t):
    """A catalogue in which each document is a table whose columns are its words."""
    catalog = t.documents.select(
        F.col("doc_id").cast("string").alias("table"), F.explode(F.split("text", " ")).alias("column")
    )
    return profile.domain_scores(catalog).drop("keywords")


@query(
    """SELECT l.n AS left_rows, r.n AS right_rows, CAST(4 AS BIGINT) AS left_columns, CAST(4 AS BIGINT) AS right_columns,
       'nationkey' AS shared, 'acctbal,custkey,segment' AS left_only, 'balance,name,suppkey' AS right_only,
       r.n - l.n AS row_delta
       FROM (SELECT count(*) AS n FROM customer) l, (SELECT count(*) AS n FROM supplier) r"""
)
def compare_datasets(t):
    left = t.customer.selectExpr(
        "c_custkey AS custkey", "c_nationkey AS nationkey", "c_acctbal AS acctbal", "c_mktsegment AS segment"
    )
    right = t.supplier.selectExpr(
        "s_suppkey AS suppkey", "s_nationkey AS nationkey", "s_acctbal AS balance", "s_name AS name"
    )
    return texts(profile.compare_datasets(left, right), "shared", "left_only", "right_only")
