"""Cleaning steps and the whole plan."""

from __future__ import annotations


from tablescope.config import SETTINGS
from tablescope.operators import clean
from tablescope.operators.clean import NULL_TEXTS
from workload.registry import query, with_messy

_NULLS = ", ".join(f"'{v}'" for v in NULL_TEXTS)
_TEXT = ["revenue_txt", "priority", "status", "order_date_txt"]
_OTHER = ["order_id", "customer_id", "amount", "sparse_col", "constant_col"]


def _nulled(c: str) -> str:
    return f"CASE WHEN regexp_replace({c}, '^\\s+|\\s+$', '', 'g') NOT IN ({_NULLS}) THEN {c} END"


def _tidy(c: str) -> str:
    return f"trim(regexp_replace({_nulled(c)}, '\\s+', ' ', 'g'))"


_TIDY = f"SELECT {', '.join(_OTHER)}, {', '.join(f'{_tidy(c)} AS {c}' for c in _TEXT)} FROM messy_orders"
_BASE = f"base AS (SELECT DISTINCT * FROM ({_TIDY}))"


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM base WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


_FILLED = (
    "filled AS (SELECT order_id, customer_id, coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM base)) AS amount, "
    + ", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in _TEXT)
    + " FROM base)"
)


def _bound(c: str, high: bool) -> str:
    rank = "(SELECT count(*) - 1 - CAST(floor(0.01 * count(*)) AS BIGINT) FROM base)" if high else \
        "(SELECT CAST(floor(0.01 * count(*)) AS BIGINT) FROM base)"
    return f"(SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r FROM filled) WHERE r = {rank})"


_NUMBERS = ["order_id", "customer_id", "amount"]
_BOUNDED = (
    "bounded AS (SELECT "
    + ", ".join(f"least(greatest({c}, {_bound(c, False)}), {_bound(c, True)}) AS {c}" for c in _NUMBERS)
    + ", " + ", ".join(_TEXT) + " FROM filled)"
)


def _collapsed(c: str) -> str:
    return (
        f"CASE WHEN (SELECT count(*) FROM (SELECT {c} FROM bounded GROUP BY {c} "
        f"HAVING count(*) >= 0.02 * (SELECT count(*) FROM bounded))) = 0 "
        f"OR (SELECT count(DISTINCT {c}) FROM bounded) <= 2 THEN {c} "
        f"WHEN {c} IN (SELECT {c} FROM bounded GROUP BY {c} "
        f"HAVING count(*) >= 0.02 * (SELECT count(*) FROM bounded)) THEN {c} ELSE 'Other' END AS {c}"
    )


@query(with_messy(f"SELECT order_id, {', '.join(f'{_nulled(c)} AS {c}' for c in _TEXT)} FROM messy_orders"))
def standardize_nulls(t):
    return clean.standardize_nulls(t.messy_orders.select("order_id", *_TEXT))


@query(with_messy(
    f"SELECT order_id, {', '.join(f'{_tidy(c)} AS {c}' for c in _TEXT)} FROM messy_orders"
))
def standardize_text(t):
    return clean.standardize_text(clean.standardize_nulls(t.messy_orders.select("order_id", *_TEXT)))


@query(with_messy(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(CASE WHEN {c} IS NOT NULL AND ({_nulled(c)}) IS NULL THEN 1 END) AS placeholders, "
    f"count(CASE WHEN ({_nulled(c)}) <> ({_tidy(c)}) THEN 1 END) AS respaced FROM messy_orders"
    for c in _TEXT
)))
def text_audit(t):
    return clean.text_audit(t.messy_orders)


@query(with_messy("SELECT DISTINCT * FROM messy_orders"))
def drop_duplicates(t):
    return clean.drop_duplicates(t.messy_orders)


@query(with_messy(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN (count(*) - count({c})) > 0.6 * count(*) THEN 'sparse' ELSE 'constant' END AS reason "
    f"FROM messy_orders HAVING (count(*) - count({c})) > 0.6 * count(*) OR count(DISTINCT {c}) <= 1"
    for c in _TEXT + _OTHER
)))
def drop_sparse_and_constant(t):
    n, facts = clean.column_facts(t.messy_orders)
    dropped = clean.sparse_and_constant(n, facts)
    return t.spark.createDataFrame(list(dropped.items()), "column string, reason string")


@query(with_messy(f"WITH {_BASE}, {_FILLED} SELECT * FROM filled"))
def impute(t):
    return clean.clean_upto(t.messy_orders, 5)


@query(with_messy(
    f"WITH {_BASE}, {_FILLED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({_bound(c, False)} AS DOUBLE) AS low, CAST({_bound(c, True)} AS DOUBLE) AS high"
        for c in _NUMBERS
    )
))
def winsor_bounds(t):
    plan, _ = clean.fit_plan(t.messy_orders)
    bounds = next(s.values for s in plan.steps if s.kind == "winsorize")
    found = [(c, float(low), float(high)) for c, (low, high) in bounds.items()]
    return t.spark.createDataFrame(found, "column string, low double, high double")


@query(
    f"""WITH b AS (SELECT o_orderkey, 9007199254740993 + o_orderkey AS big FROM orders),
    r AS (SELECT big, row_number() OVER (ORDER BY big) - 1 AS i, count(*) OVER () AS n FROM b),
    e AS (SELECT max(CASE WHEN i = k THEN big END) AS low, max(CASE WHEN i = n - k - 1 THEN big END) AS high
          FROM (SELECT *, CAST(floor(CAST({SETTINGS.winsor_frac} AS DOUBLE) * n) AS BIGINT) AS k FROM r))
    SELECT o_orderkey, least(greatest(big, low), high) AS big FROM b, e"""
)
def winsorize_big_keys(t):
    """Whole numbers beyond 2^53 keep every digit."""
    table = t.orders.selectExpr("o_orderkey", "9007199254740993 + o_orderkey AS big")
    return clean.winsorize(table, clean.winsor_bounds(table, ["big"], table.count()))


@query(with_messy(f"WITH {_BASE}, {_FILLED}, {_BOUNDED} SELECT * FROM bounded"))
def winsorize(t):
    return clean.clean_upto(t.messy_orders, 6)


@query(with_messy(
    f"WITH {_BASE}, {_FILLED}, {_BOUNDED} "
    f"SELECT order_id, customer_id, amount, {', '.join(_collapsed(c) for c in _TEXT)} FROM bounded"
))
def clean_table(t):
    """All steps: the cleaned table."""
    return clean.clean(t.messy_orders)[0]


@query(with_messy(
    f"""WITH {_BASE}, {_FILLED}
    SELECT 'rows_before' AS metric, CAST(count(*) AS VARCHAR) AS value FROM messy_orders
    UNION ALL SELECT 'rows_after', CAST(count(*) AS VARCHAR) FROM base
    UNION ALL SELECT 'rows_removed',
      CAST((SELECT count(*) FROM messy_orders) - (SELECT count(*) FROM base) AS VARCHAR)"""
))
def cleaning_report(t):
    _, report = clean.clean(t.messy_orders)
    return report.filter("step = 'drop_duplicates'").select("metric", "value")


@query(with_messy(f"WITH {_BASE} SELECT * FROM base"))
def replay_three_steps(t):
    plan, _ = clean.fit_plan(t.messy_orders)
    return clean.replay(t.messy_orders, plan, 3)


@query(
    """SELECT 'o_orderpriority' AS "column", o_orderpriority AS mode FROM orders
       GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1"""
)
def mode_of_column(t):
    _, facts = clean.column_facts(t.orders.select("o_orderpriority"))
    return t.spark.createDataFrame([(c, f.mode) for c, f in facts.items()], "column string, mode string")
