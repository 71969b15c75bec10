"""Reading, writing and normalising."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablescope.functions.columns import col
from tablescope.functions.parsing import parse_number, parse_timestamp
from tablescope.operators import filters, ingest
from tablescope.operators.outliers import robust_z_flags
from tablescope.plans.storage import shared_folder
from tablescope.sources import (
    read_json,
    read_parquet,
    read_table,
    write_csv,
    write_json,
    write_report,
)
from workload.registry import Tables, query, with_messy

# DuckDB's reading of a number in text, with the same symbols stripped.
NUMBER_SQL = (
    "CASE WHEN regexp_matches({b}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
    "THEN TRY_CAST({b} AS DOUBLE) END"
)


def number_sql(column: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({column}), '[$₹€£¥,\\s]', '', 'g'), '%\\s*$', '')"
    return NUMBER_SQL.format(b=bare)


DATE_SQL = (
    "coalesce(try_strptime(trim({c}), '%Y-%m-%d'), try_strptime(trim({c}), '%m/%d/%Y'), "
    "try_strptime(trim({c}), '%m-%d-%Y'))"
)


def _new_folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/tablescope/{uuid.uuid4().hex}"


@query("SELECT * FROM customer")
def csv_round_trip(t):
    """write_csv, read_table, then normalise back to numbers."""
    folder = _new_folder(t)
    write_csv(t.customer, folder)
    back = ingest.normalise(read_table(t.spark, folder, "csv")).df
    return back.withColumns({"c_custkey": F.col("c_custkey").cast("long"), "c_nationkey": F.col("c_nationkey").cast("int")})


@query(
    """SELECT doc_id, md5(text || ' say "x",\nok ') AS digest, source FROM documents"""
)
def csv_round_trip_of_texts(t):
    """Texts with line breaks, quotes, commas and blanks at the ends come back as they went."""
    folder = _new_folder(t)
    line = F.concat("text", F.lit(' say "x",\nok '))
    write_csv(t.documents.select("doc_id", line.alias("line"), "source"), folder)
    back = read_table(t.spark, folder, "csv")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("line").alias("digest"), "source")


_LAYOUTS = {
    "iso_minutes": ("yyyy-MM-dd HH:mm", "minute"), "iso_millis": ("yyyy-MM-dd HH:mm:ss.SSS", "millisecond"),
    "zulu": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"), "noon": ("MM/dd/yyyy hh:mm a", "minute"),
    "dotted": ("dd.MM.yyyy", "day"), "compact": ("yyyyMMdd", "day"), "named": ("MMM d yyyy", "day"),
    "dashed": ("d-MMM-yyyy", "day"), "month": ("yyyy-MM", "month"), "short": ("M/d/yy", "day"),
}


# name: (how the event's time is written, what is read back)
_WRITTEN = {
    "offset": (lambda ts: F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200")), "date_trunc('second', ts) - INTERVAL 2 HOUR"),
    "compact_time": (lambda ts: F.date_format(ts, "yyyyMMdd'T'HHmmss"), "date_trunc('second', ts)"),
    "mail": (lambda ts: F.date_format(ts, "EEE, dd MMM yyyy"), "date_trunc('day', ts)"),
    "long_day": (lambda ts: F.date_format(ts, "d MMMM yyyy HH:mm"), "date_trunc('minute', ts)"),
    "named_noon": (lambda ts: F.date_format(ts, "MMM d, yyyy h:mm a"), "date_trunc('minute', ts)"),
    "slashed_millis": (lambda ts: F.date_format(ts, "MM/dd/yyyy HH:mm:ss.SSS"), "date_trunc('millisecond', ts)"),
    "zone_name": (lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'"), "date_trunc('second', ts)"),
    "slashed_year": (lambda ts: F.date_format(ts, "yyyy/MM/dd HH:mm"), "date_trunc('minute', ts)"),
    "named_month": (lambda ts: F.date_format(ts, "MMM-yyyy"), "date_trunc('month', ts)"),
    "ordinal": (
        lambda ts: F.concat(
            F.dayofmonth(ts),
            F.when(F.dayofmonth(ts).isin(1, 21, 31), "st").when(F.dayofmonth(ts).isin(2, 22), "nd")
            .when(F.dayofmonth(ts).isin(3, 23), "rd").otherwise("th"),
            F.date_format(ts, " MMMM yyyy"),
        ),
        "date_trunc('day', ts)",
    ),
    "iso_week": (
        lambda ts: F.concat(F.extract(F.lit("YEAROFWEEK"), ts), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")),
        "date_trunc('week', ts)",
    ),
    "last_century": (lambda ts: F.date_format(ts - F.expr("INTERVAL 25 YEARS"), "M/d/yy"), "date_trunc('day', ts) - INTERVAL 25 YEAR"),
}


@query(" UNION ALL ".join(
    [f"SELECT event_id, '{name}' AS layout, date_trunc('{unit}', ts) AS read FROM events" for name, (_, unit) in _LAYOUTS.items()]
    + [f"SELECT event_id, '{name}' AS layout, {read} AS read FROM events" for name, (_, read) in _WRITTEN.items()]
))
def parse_date_layouts(t):
    """Each event's time written in each layout and read back."""
    texts = {n: F.date_format("ts", p) for n, (p, _) in _LAYOUTS.items()} | {n: w(F.col("ts")) for n, (w, _) in _WRITTEN.items()}
    written = F.array(*[F.struct(F.lit(n).alias("layout"), x.alias("text")) for n, x in texts.items()])
    return t.events.select("event_id", F.inline(written)).select("event_id", "layout", parse_timestamp(F.col("text")).alias("read"))


@query("SELECT p_name, p_type FROM part WHERE regexp_matches(p_name, '^[^0-9]+$') OR regexp_matches(p_type, '^[^0-9]+$')")
def search_negated_class(t):
    """A class written in capitals is not its small counterpart."""
    return filters.search_rows(t.part.select("p_name", "p_type"), r"^\D+$")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def tsv_read(t):
    folder = _new_folder(t)
    t.part.write.option("header", True).option("sep", "\t").csv(folder)
    back = ingest.normalise(read_table(t.spark, folder, "tsv")).df
    return back.withColumns({"p_partkey": F.col("p_partkey").cast("long"), "p_size": F.col("p_size").cast("int")})


@query(
    """SELECT o_orderkey, o_orderstatus AS "order.status", o_totalprice AS "order.price",
              o_custkey AS "customer.key" FROM orders"""
)
def json_round_trip(t):
    """write_json with nested records, read_json flattens them to dotted names."""
    folder = _new_folder(t)
    nested = t.orders.select(
        "o_orderkey",
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("order"),
        F.struct(F.col("o_custkey").alias("key")).alias("customer"),
    )
    write_json(nested, folder)
    return read_json(t.spark, folder)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_record_list(t):
    """One document per line that wraps a list of records."""
    folder = _new_folder(t)
    record = F.struct("conv_id", "turn", "role", "text")
    write_json(t.conversations.select(F.array(record).alias("records")), folder)
    return read_json(t.spark, folder, record_path="records", lines=True)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_wrapped_folder(t):
    """A folder of documents, one to a file, each with the records of twenty conversations under ``data``."""
    folder = _new_folder(t)
    record = F.struct("conv_id", "turn", "role", "text")
    documents = t.conversations.groupBy(F.floor(F.col("conv_id") / 20).alias("page")).agg(F.collect_list(record).alias("data"))
    documents.write.option("maxRecordsPerFile", 1).json(folder)
    return read_json(t.spark, folder)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def parquet_read(t):
    folder = _new_folder(t)
    write_report({"data": t.orders}, folder)
    stored = read_parquet(t.spark, f"{folder}/data")
    return stored.filter("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, n_name, n_name AS n_name_1, n_regionkey FROM nation")
def dedupe_columns(t):
    doubled = t.nation.select("n_nationkey", "n_name", "n_name", "n_regionkey")
    return ingest.rename_duplicates(doubled)


@query(with_messy(
    "SELECT revenue_txt, amount, sparse_col FROM messy_orders "
    "WHERE NOT (revenue_txt IS NULL AND amount IS NULL AND sparse_col IS NULL)"
))
def drop_empty_rows(t):
    return ingest.drop_empty_rows(t.messy_orders.select("revenue_txt", "amount", "sparse_col"))


@query(with_messy(
    "SELECT 'blank' AS \"column\" FROM messy_orders HAVING count(CAST(NULL AS VARCHAR)) = 0"
))
def empty_columns(t):
    table = t.messy_orders.withColumn("blank", F.lit(None).cast("string"))
    return t.spark.createDataFrame([(c,) for c in ingest.empty_columns(table)], "column string")


@query(with_messy(f"SELECT order_id, {number_sql('revenue_txt')} AS revenue FROM messy_orders"))
def coerce_numeric(t):
    return t.messy_orders.select("order_id", parse_number(F.col("revenue_txt")).alias("revenue"))


@query(with_messy(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count({number_sql(c)}) AS parsed FROM messy_orders"
    for c in ("revenue_txt", "priority", "status", "order_date_txt")
)))
def coercion_rates(t):
    return ingest.coercion_rates(t.messy_orders)


@query(with_messy(
    f"SELECT order_id, {number_sql('revenue_txt')} AS revenue_txt, priority, status, order_date_txt FROM messy_orders"
))
def try_coerce_columns(t):
    table = t.messy_orders.select("order_id", "revenue_txt", "priority", "status", "order_date_txt")
    return ingest.try_coerce_columns(table)


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 1 THEN o_totalprice END AS price FROM orders"
)
def sanitize_infinities(t):
    planted = t.orders.select(
        "o_orderkey",
        F.expr(
            "CASE o_orderkey % 10 WHEN 0 THEN double('Infinity') WHEN 1 THEN double('NaN') ELSE o_totalprice END"
        ).alias("price"),
    )
    return ingest.sanitize_infinities(planted)


@query(with_messy(
    f"SELECT order_id, {DATE_SQL.format(c='order_date_txt')} AS order_date FROM messy_orders"
))
def parse_dates(t):
    return t.messy_orders.select("order_id", parse_timestamp(F.col("order_date_txt")).alias("order_date"))


@query(with_messy(
    f"SELECT order_id, priority, {DATE_SQL.format(c='order_date_txt')} AS order_date_txt FROM messy_orders"
))
def infer_datetimes(t):
    return ingest.infer_datetimes(t.messy_orders.select("order_id", "priority", "order_date_txt"))


def _narrow_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' "
        f"WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' "
        f"WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS dtype FROM {table}"
        for c in columns
    )


@query(_narrow_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))
def narrow_types(t):
    narrowed = ingest.narrow_types(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return t.spark.createDataFrame(narrowed.dtypes, "column string, dtype string")


MESSY_COLUMNS = [
    "order_id", "customer_id", "revenue_txt", "amount", "priority", "status", "order_date_txt", "sparse_col",
    "constant_col",
]


@query(with_messy(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct, count(DISTINCT {c}) AS cardinality "
    "FROM messy_orders"
    for c in MESSY_COLUMNS
)))
def schema_report(t):
    return ingest.schema_report(t.messy_orders).drop("dtype")


@query(with_messy(
    "SELECT count(*) AS rows, CAST(9 AS BIGINT) AS columns, "
    + " + ".join(f"count(*) - count({c})" for c in MESSY_COLUMNS)
    + " AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy_orders)) AS duplicate_rows "
    "FROM messy_orders"
))
def validate(t):
    v = ingest.validate(t.messy_orders)
    return t.spark.createDataFrame(
        [(v.rows, v.columns, v.missing_cells, v.duplicate_rows)],
        "rows long, columns long, missing_cells long, duplicate_rows long",
    )


@query(with_messy(
    f"SELECT order_id, customer_id, {number_sql('revenue_txt')} AS revenue_txt, amount, priority, status, "
    f"{DATE_SQL.format(c='order_date_txt')} AS order_date_txt, sparse_col, constant_col FROM messy_orders"
))
def normalise_table(t):
    """All ingest steps at once; widths are put back for the comparison."""
    table = t.messy_orders
    done = ingest.normalise(table).df
    wide = {c: F.col(c).cast("long") for c in ("order_id", "customer_id")}
    return done.withColumns({**wide, "constant_col": F.col("constant_col").cast("int")})


@query()
def sample_rows(t):
    return ingest.sample_rows(t.lineitem)


@query(
    """SELECT least(count(*), 20000) AS sampled, CAST(0 AS BIGINT) AS strays, CAST(0 AS BIGINT) AS repeats FROM lineitem"""
)
def sample_rows_check(t):
    """The sample has the wanted size and holds rows of the table, each at most once."""
    sample = ingest.sample_rows(t.lineitem)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    held = sample.groupBy(*keys).agg(F.count("*").alias("n"))
    there = t.lineitem.groupBy(*keys).agg(F.count("*").alias("m"))
    return held.join(there, keys, "left").agg(
        F.sum("n").alias("sampled"),
        F.count_if(F.col("m").isNull()).alias("strays"),
        F.count_if(F.col("n") > F.col("m")).alias("repeats"),
    )


@query(
    """SELECT page_id, url FROM pages
    WHERE regexp_matches(lower(html), 'aulich|/and"') OR regexp_matches(lower(url), 'aulich|/and"')"""
)
def search_pages(t):
    """A pattern over whole pages."""
    return filters.search_rows(t.pages, 'aulich|/and"').select("page_id", "url")


@query("SELECT * FROM customer WHERE c_name ILIKE '%building%' OR c_mktsegment ILIKE '%building%'")
def search_rows(t):
    return filters.search_rows(t.customer, " Building ")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 500")
def preview(t):
    return filters.preview(t.customer.select("c_custkey", "c_name", "c_acctbal"), order_by=["c_acctbal", "c_custkey"])


@query(with_messy(
    "SELECT order_id, revenue_txt, amount FROM messy_orders WHERE revenue_txt IS NOT NULL AND amount IS NOT NULL"
))
def complete_rows(t):
    return filters.complete_rows(t.messy_orders, ["order_id", "revenue_txt", "amount"])


@query(with_messy(
    """WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2,
                        quantile_cont(amount, 0.75) AS q3 FROM messy_orders)
    SELECT order_id, round(abs(amount - q2) / ((q3 - q1) * 0.7413), 4) AS z
    FROM messy_orders, q WHERE abs(amount - q2) / ((q3 - q1) * 0.7413) > 3"""
))
def flagged_rows(t):
    flagged = robust_z_flags(t.messy_orders, ["amount"]).withColumn("score", F.get("spikes", F.lit(0))["z"])
    found = filters.flagged_rows(flagged, "is_spike", "score")
    return found.select("order_id", F.round(col("score"), 4).alias("z"))
