import pytest
from pyspark.sql import functions as F

from tablescope.errors import ValidationError
from tablescope.functions.columns import (
    categorical_cols,
    existing_columns,
    numeric_cols,
    require_numeric,
)
from tablescope.functions.parsing import parse_number, parse_timestamp
from tablescope.operators import filters, ingest
from tablescope.sources import read_delimited, read_json, read_table, write_csv, write_json, write_report


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_what_is_written_is_read(spark, tmp_path):
    source = spark.createDataFrame([(7, -3), (12, 40), (90, 0)], "load int, shift int")
    folder = str(tmp_path / "out")
    write_csv(source, folder)
    back = ingest.normalise(read_table(spark, folder, "csv")).df
    assert {(r["load"], r["shift"]) for r in back.collect()} == {(7.0, -3.0), (12.0, 40.0), (90.0, 0.0)}


@pytest.mark.parametrize("name", ["picture.webp", "absent.csv"])
def test_what_cannot_be_read_is_an_error(spark, tmp_path, name):
    if name == "picture.webp":
        write(tmp_path, name, "RIFF")
    with pytest.raises(ValidationError):
        read_table(spark, str(tmp_path / name))


def test_line_breaks_in_cells_stay_in_their_cell(spark, tmp_path):
    rows = [("a\nb", "1"), ('say ""\n"x"', "2"), ("\n", "3"), ("plain", "4"), ("r\r\nn", "5"), (' 5" pipe', "6")]
    folder = str(tmp_path / "out")
    write_csv(spark.createDataFrame(rows, "t string, n string").coalesce(1), folder)
    assert sorted(map(tuple, read_table(spark, folder, "csv").collect()), key=lambda r: r[1]) == rows


def test_only_files_with_line_breaks_are_read_whole(spark, tmp_path):
    folder = tmp_path / "a folder + more"
    folder.mkdir()
    (folder / "one.csv").write_text('t,n\n"x\ny",1\nz,2\n')
    (folder / "two.csv").write_text("t,n\nu,3\nv,4\n")
    (folder / "three.csv").write_text("n,t\n5,w\n")
    df = read_table(spark, str(folder), "csv")
    assert {tuple(r) for r in df.collect()} == {("x\ny", "1"), ("z", "2"), ("u", "3"), ("v", "4"), ("w", "5")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3


def test_header_cells_with_line_breaks(spark, tmp_path):
    path = write(tmp_path, "h.csv", '"first\nname",n\nx,1\n')
    df = read_table(spark, path)
    assert df.columns == ["first\nname", "n"] and [tuple(r) for r in df.collect()] == [("x", "1")]


def test_stray_quotes_invent_no_rows(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'a,b\n5" pipe,1\n6,2\nx"y"z,3\n')
    assert {tuple(r) for r in read_table(spark, path).collect()} == {('5" pipe', "1"), ("6", "2"), ('x"y"z', "3")}


def test_folder_of_wrapped_documents(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(f'{{"page": {k}, "data": [{{"n": {2 * k}}}, {{"n": {2 * k + 1}}}]}}')
    assert sorted(values(read_json(spark, str(tmp_path)), "n")) == [0, 1, 2, 3, 4, 5]


def test_long_rows_are_skipped_and_short_rows_padded(spark, tmp_path):
    path = write(tmp_path, "x.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x,y",NA,"q ""z"""\n')
    got = {tuple(r) for r in read_table(spark, path).collect()}
    assert got == {("1", "2", "3"), ("4", "5", None), ("x,y", None, 'q "z"')}


def test_encodings(spark, tmp_path):
    latin = write(tmp_path, "l.csv", "name,n\ncaf\xe9,1\n".encode("latin-1"))
    assert values(read_delimited(spark, latin), "name") == ["café"]
    bom = write(tmp_path, "b.csv", "﻿name,n\ncafé,1\n".encode())
    assert read_delimited(spark, bom).columns == ["name", "n"]
    tabs = write(tmp_path, "t.tsv", "a\tb\n1\t2\n")
    assert tuple(read_table(spark, tabs).first()) == ("1", "2")


def test_header_repeats_and_blanks(spark, tmp_path):
    assert ingest.dedupe_columns(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert ingest.dedupe_columns([" ", "x ", "X"]) == ["unnamed", "x", "X_1"]
    assert read_table(spark, write(tmp_path, "h.csv", "a,a,,b\n1,2,3,4\n")).columns == ["a", "a_1", "unnamed", "b"]


def test_json_shapes(spark, tmp_path):
    listed = write(tmp_path, "l.json", '[{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": "y"}}]')
    df = read_table(spark, listed)
    assert sorted(df.columns) == ["a", "b.c"]
    assert sorted(r["b.c"] for r in df.collect()) == ["x", "y"]
    wrapped = write(tmp_path, "w.json", '{"note": "n", "records": [{"a": 1}, {"a": 2}, {"a": 3}]}')
    assert sorted(values(read_json(spark, wrapped), "a")) == [1, 2, 3]
    single = write(tmp_path, "s.json", '{"a": 7, "tags": [1, 2]}')
    assert read_json(spark, single).first()["tags"] == [1, 2]
    broken = write(tmp_path, "x.json", '{"a": ')
    with pytest.raises(ValidationError):
        read_table(spark, broken)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "n int, s string")
    write_json(df, str(tmp_path / "j"))
    assert read_json(spark, str(tmp_path / "j"), lines=True).count() == 2
    write_report({"data": df, "schema": ingest.schema_report(df)}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "schema")).count() == 2


@pytest.mark.parametrize(
    "text, number",
    [
        ("$1,200.50", 1200.5), ("45%", 45.0), ("45 % ", 45.0), ("₹ 3,00", 300.0), ("1e3", 1000.0), ("-.5", -0.5),
        ("1d", None), ("0x10", None), ("N/A", None), ("", None), ("abc", None), ("inf", float("inf")),
    ],
)
def test_numbers_in_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_number(F.col("t")).alias("n")).first()["n"] == number


@pytest.mark.parametrize(
    "text, day",
    [
        ("2023-12-25", "2023-12-25 00:00:00"), ("25/12/2023", "2023-12-25 00:00:00"),
        ("03/04/2023", "2023-03-04 00:00:00"), ("12-25-2023", "2023-12-25 00:00:00"),
        ("December 25, 2023", "2023-12-25 00:00:00"), ("2023-12-25T10:30:00", "2023-12-25 10:30:00"),
        ("not-a-date", None), ("2023-13-45", None), ("2024-01-05T10:00:00+0200", "2024-01-05 08:00:00"),
        ("20240105T103000", "2024-01-05 10:30:00"), ("Fri, 05 Jan 2024", "2024-01-05 00:00:00"),
        ("5 January 2024 10:00", "2024-01-05 10:00:00"), ("Jan 5, 2024 10:30 PM", "2024-01-05 22:30:00"),
        ("01/05/2024 22:30:15.123", "2024-01-05 22:30:15.123"), ("2024-01-05 10:00:00 UTC", "2024-01-05 10:00:00"),
        ("2024/01/05 10:00", "2024-01-05 10:00:00"), ("Jan-2024", "2024-01-01 00:00:00"),
        ("5th January 2024", "2024-01-05 00:00:00"), ("2024-W01", "2024-01-01 00:00:00"), ("1/5/99", "1999-01-05 00:00:00"),
        ("1/5/68", "2068-01-05 00:00:00"), ("2020-W53-7", "2021-01-03 00:00:00"), ("2021-W53", None),
        ("2024-01-05 12:05 am", "2024-01-05 00:05:00"), ("2024-01-05 13:05 pm", None), ("31/04/2024", None),
        ("Sept. 3rd, 2021 at 7 pm", "2021-09-03 19:00:00"), ("2024-02-30", None), ("2024-01-05T10:00:00.123456789Z", "2024-01-05 10:00:00.123456"),
        ("2024-01-05 10:00:00-05:30", "2024-01-05 15:30:00"), ("3 of May 2020", "2020-05-03 00:00:00"), ("2024 Mar 7", "2024-03-07 00:00:00"),
        ("may", None), ("2024", None), ("12", None), ("1.5", None), ("2024.05", None), ("", None), ("05.01.2024", "2024-01-05 00:00:00"),
        ("2024-01/05", None), ("10:30", None), ("Monday", None), ("marching 5 2024", None), ("2024-01-05 25:00", None),
    ],
)
def test_dates_in_text(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).cast("string").alias("d"))
    assert got.first()["d"] == day


def test_order_of_day_and_month(spark):
    df = spark.createDataFrame([("03/04/2023",), ("25/12/2023",), ("7/8/2023 10:00",)], "d string")
    first = df.select(parse_timestamp(F.col("d"), day_first=True).cast("string").alias("d"))
    assert values(first, "d") == ["2023-04-03 00:00:00", "2023-12-25 00:00:00", "2023-08-07 10:00:00"]
    # by value: the month stands first wherever it can; by column: one value that cannot decides for all
    assert values(ingest.infer_datetimes(df), "d")[0].isoformat() == "2023-03-04T00:00:00"
    assert values(ingest.infer_datetimes(df, day_order="column"), "d")[0].isoformat() == "2023-04-03T00:00:00"
    both = df.unionByName(spark.createDataFrame([("12/25/2023",)], "d string"))
    assert values(ingest.infer_datetimes(both, day_order="column"), "d")[0].isoformat() == "2023-03-04T00:00:00"


def test_own_layouts(spark):
    df = spark.createDataFrame([("2024|05|06",), ("2024-05-06",)], "d string")
    assert [str(v) for v in values(df.select(parse_timestamp(F.col("d"), ["yyyy'|'MM'|'dd"]).alias("d")), "d")] == ["2024-05-06 00:00:00", "None"]


def test_normalise(spark, messy):
    done = ingest.normalise(messy)
    kinds = dict(done.df.dtypes)
    assert kinds["revenue"] == "double" and kinds["date"] == "timestamp_ntz" and kinds["region"] == "string"
    assert kinds["id"] == "tinyint"
    assert done.df.filter("date IS NULL").count() == 5
    assert done.notes


def test_text_columns_stay_text(spark):
    df = spark.createDataFrame([("a1",), ("b",), ("3",), ("x",)], "t string")
    assert dict(ingest.normalise(df).df.dtypes) == {"t": "string"}


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert ingest.drop_empty_rows(df).count() == 1
    assert ingest.empty_columns(df) == ["b"]
    assert "1 empty rows dropped" in ingest.normalise(df).notes


def test_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.5,)], "x double")
    assert sorted(values(ingest.sanitize_infinities(df), "x"), key=str) == [1.5, None, None]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 40_000, 68423.46), (2, -1, 1.1)], "a long, b long, x double")
    assert dict(ingest.narrow_types(df).dtypes) == {"a": "tinyint", "b": "int", "x": "double"}
    exact = spark.createDataFrame([(0.5,), (2.0,)], "x double")
    assert dict(ingest.narrow_types(exact, floats=True).dtypes) == {"x": "float"}


def test_validate(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (None, "x")], "a int, b string")
    found = ingest.validate(df)
    assert found.valid and found.missing_cells == 1 and found.duplicate_rows == 0 and found.numeric_columns == ["a"]
    with pytest.raises(ValidationError):
        ingest.validate(df.limit(0))
    assert ingest.validate(df.limit(0), allow_empty=True).rows == 0
    with pytest.raises(ValidationError):
        ingest.validate(df.select())


def test_column_lists(spark):
    df = spark.createDataFrame([("alice", 1, True)], "name string, value int, flag boolean")
    assert categorical_cols(df) == ["name"] and numeric_cols(df) == ["value"]
    assert existing_columns(df, ["value", "gone"]) == ["value"]
    with pytest.raises(ValidationError):
        require_numeric(df, "name")
    with pytest.raises(ValidationError):
        require_numeric(df, "gone")


def test_sample_rows(spark):
    df = spark.range(0, 5_000, 1, 4)
    first, again = (sorted(r["id"] for r in ingest.sample_rows(df, 100).collect()) for _ in range(2))
    assert len(first) == 100 and first == again
    assert ingest.sample_rows(df, 5_000).count() == 5_000
    copies = df.selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS v")
    share = ingest.sample_rows(copies, 600).filter("v = 0").count() / 600
    assert 0.23 < share < 0.44


def test_filters(spark):
    df = spark.createDataFrame([("Alpha", 10), ("beta", 20), (None, 30)], "name string, n int")
    assert values(filters.search_rows(df, " ALPHA "), "n") == [10]
    assert sorted(values(filters.search_rows(df, "a|30"), "n")) == [10, 20, 30]
    assert filters.search_rows(df, "  ").count() == 3
    assert values(filters.preview(df, 2, ["n"]), "n") == [10, 20]
    assert filters.complete_rows(df, ["name"]).count() == 2
