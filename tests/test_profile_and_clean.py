import pytest
from pyspark.sql import functions as F

from tablescope.operators import clean, profile, semantics
from tablescope.streaming.replay import clean_stream


def types_of(df):
    return {r["column"]: r["semantic_type"] for r in semantics.infer_semantic_types(df).collect()}


def score(df):
    return df.first()["score"]


def test_types_of_the_messy_table(messy):
    found = types_of(messy)
    assert found["constant_col"] == "constant" and found["sparse_col"] == "constant"
    assert found["id"] == "id" and found["region"] == "categorical"


def test_type_rules(spark):
    df = spark.range(200).selectExpr(
        "id % 2 = 0 AS flag",
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS moment",
        "CAST(id % 2 AS INT) AS two",
        "CAST(id % 5 AS INT) AS rating",
        "CAST(id % 50 AS DOUBLE) / 7 AS amount",
        "CAST(id AS DOUBLE) * 1.5 AS all_differ",
        "element_at(array('Low', ' medium', 'HIGH '), CAST(id % 3 + 1 AS INT)) AS grade",
        "CASE WHEN id < 150 THEN concat('a rather long remark with number ', id) ELSE 'a rather long remark, repeated' END AS remark",
        "CASE WHEN id < 150 THEN concat('v', id) ELSE 'x' END AS jumble",
        "concat('c', id % 7) AS kind",
        "CASE WHEN id = 0 THEN 1 ELSE id END AS user_id",
        "CAST(NULL AS STRING) AS nothing",
    )
    assert types_of(df) == {
        "flag": "boolean", "moment": "datetime", "two": "binary", "rating": "ordinal", "amount": "numeric",
        "all_differ": "id", "grade": "ordinal", "remark": "text", "jumble": "mixed", "kind": "categorical",
        "user_id": "id", "nothing": "constant",
    }


def test_integer_with_gaps_is_not_ordinal(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,), (1,), (2,)], "n int")
    assert types_of(df) == {"n": "numeric"}


def test_schema_table(messy):
    rows = {r["column"]: r for r in semantics.build_schema(messy).collect()}
    assert rows["sparse_col"]["missing_pct"] == 95.0
    assert rows["region"]["samples"] == ["east", "north", "south", "west"]
    assert rows["id"]["samples"] == ["1", "2", "3", "4", "5"]
    chosen = semantics.columns_of_type(semantics.build_schema(messy), "constant")
    assert {r["column"] for r in chosen.collect()} == {"constant_col", "sparse_col"}


def test_quality_scores(spark, messy):
    assert score(profile.completeness(messy)) == pytest.approx(100 * (120 - 5 - 19) / 120)
    assert score(profile.uniqueness(messy.unionAll(messy))) == 50.0
    assert score(profile.completeness(messy.limit(0))) == 0.0
    assert score(profile.uniqueness(messy.limit(0))) == 100.0
    cased = spark.createDataFrame([("a",), ("A",), ("b",), ("c",)] * 3, "s string")
    assert score(profile.consistency(cased)) == pytest.approx(70.0)
    inf = spark.createDataFrame([(float("inf"), 1), (1.0, 2)], "x double, n int")
    assert score(profile.validity(inf)) == 75.0
    assert score(profile.validity(cased)) == 100.0


def test_profile_is_within_bounds(messy):
    row = profile.profile_dataset(messy).first()
    assert 0 <= row["overall"] <= 100 and (row["rows"], row["columns"]) == (20, 6)
    assert row["constant_columns"] == 2 and row["duplicate_rows"] == 0


def test_domains(spark):
    generic = spark.createDataFrame([(1, 2)], "col_a int, col_b int")
    assert profile.detect_domain(generic).first()["domain"] == "Generic"
    sales = spark.createDataFrame([(1, 2, "N", 3)], "Revenue int, Units_Sold int, Region string, Discount_Pct int")
    row = profile.detect_domain(sales).first()
    assert row["domain"] == "Sales / Retail" and row["hits"] == 4 and row["confidence"] == 1.0
    many = spark.createDataFrame([("t", c) for c in ("patient", "diagnosis", "x")] + [("u", "y")], "table string, column string")
    assert {r["table"]: r["domain"] for r in profile.domain_scores(many).collect()} == {"t": "Healthcare", "u": "Generic"}


def test_compare(spark, messy):
    row = profile.compare_datasets(messy, messy.select("id", F.lit(1).alias("extra")).limit(5)).first()
    assert row["row_delta"] == -15 and row["shared"] == ["id"] and row["right_only"] == ["extra"]


def test_cleaning_drops_sparse_and_constant(messy):
    done, report = clean.clean(messy)
    assert done.columns == ["id", "revenue", "region", "date"]
    assert done.filter("revenue IS NULL OR date IS NULL").count() == 0
    dropped = {r["column"]: r["value"] for r in report.filter("step = 'drop_columns' AND metric = 'reason'").collect()}
    assert dropped == {"constant_col": "constant", "sparse_col": "sparse"}


def test_history_and_replay(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "value int, cat string")
    plan, report = clean.fit_plan(df)
    assert len(plan.steps) == 7 and report.count() > 0
    assert clean.replay(df, plan, 0).count() == 4
    assert clean.replay(df, plan, 3).count() == 3
    assert clean.apply_plan(df, plan).count() == 3


def test_placeholders_and_spaces(spark):
    df = spark.createDataFrame([("N/A ",), ("\t",), ("a   b ",), ("None",), ("n.a.",)], "s string")
    tidy = clean.standardize_text(clean.standardize_nulls(df))
    assert sorted((r["s"] for r in tidy.collect()), key=str) == [None, None, None, "a b", "n.a."]
    audit = clean.text_audit(df).first()
    assert audit["placeholders"] == 2 and audit["respaced"] == 1


def test_imputation(spark):
    df = spark.createDataFrame(
        [(1.0, "b", 1), (2.0, "a", 2), (None, "a", 3), (9.0, "b", 4), (5.0, None, 5)], "x double, s string, n int"
    )
    rows = {r["n"]: r for r in clean.clean(df)[0].collect()}
    assert rows[3]["x"] == 3.5 and rows[5]["s"] == "a"


def test_winsorising_uses_order_statistics(spark):
    df = spark.range(1, 401).selectExpr("CAST(id AS DOUBLE) AS x", "id AS n")
    done = clean.clean(df)[0].agg(F.min("x"), F.max("x"), F.min("n"), F.max("n")).first()
    assert tuple(done) == (5.0, 396.0, 5, 396)


def test_rare_categories(spark):
    df = spark.range(1000).selectExpr(
        "id", "CASE WHEN id < 10 THEN concat('r', id) WHEN id < 500 THEN 'a' ELSE 'b' END AS s",
        "concat('u', id) AS unique_text",
    )
    done = clean.clean(df)[0]
    assert {r["s"] for r in done.select("s").distinct().collect()} == {"a", "b", "Other"}
    assert done.select("unique_text").distinct().count() == 1000


def test_plan_on_a_stream(spark, tmp_path):
    batch = spark.range(100).selectExpr("id", "CASE WHEN id % 5 = 0 THEN 'N/A' ELSE concat(' v ', id % 2) END AS s")
    plan, _ = clean.fit_plan(batch)
    source = str(tmp_path / "in")
    batch.write.parquet(source)
    stream = clean_stream(spark.readStream.schema(batch.schema).parquet(source), plan)
    run = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = sorted(map(tuple, spark.table("cleaned").collect()))
    assert got == sorted(map(tuple, clean.apply_plan(batch, plan).collect()))


def test_nan_and_infinity_count_as_gaps(spark):
    df = spark.createDataFrame(
        [(float("nan"), 1), (float("inf"), 2), (1.0, 3), (2.0, 4), (3.0, 5), (None, 6), (4.0, 7), (5.0, 8)], "x double, n int"
    )
    plan, _ = clean.fit_plan(df)
    done = {r["n"]: r["x"] for r in clean.apply_plan(df, plan).collect()}
    assert (done[1], done[2], done[6]) == (3.0, 3.0, 3.0)
    assert score(profile.completeness(df)) == pytest.approx(100 * 14 / 16)


def test_unusual_spaces(spark):
    df = spark.createDataFrame([(" N/A ",), ("a  b",)], "s string")
    tidy = clean.standardize_text(clean.standardize_nulls(df))
    assert sorted((r["s"] for r in tidy.collect()), key=str) == [None, "a b"]
