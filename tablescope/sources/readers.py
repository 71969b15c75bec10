"""Load tables from files; column types of text formats are inferred later."""

from __future__ import annotations

import csv
import io
import json
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.errors import ValidationError
from tablescope.functions.columns import col
from tablescope.operators.ingest import dedupe_columns

# File suffixes and their readers' formats, wrapper keys of JSON documents, texts read as null.
FORMATS = {"csv": "csv", "txt": "csv", "tsv": "tsv", "json": "json", "parquet": "parquet"}
RECORD_KEYS = ["data", "records", "rows", "results", "items"]
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read a file or folder, choosing the reader by ``format`` or by the path's suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = (format or (name.rsplit(".", 1)[1] if "." in name else "")).lower()
    kind = FORMATS.get(suffix)
    if kind is None:
        raise ValidationError(f"Cannot read {name!r}: known formats are {', '.join(sorted(FORMATS))}")
    try:
        if kind == "csv":
            df = read_delimited(spark, path, ",", **options)
        elif kind == "tsv":
            df = read_delimited(spark, path, "\t", **options)
        elif kind == "json":
            df = read_json(spark, path, **options)
        else:
            df = read_parquet(spark, path)
    except PySparkException as error:
        raise ValidationError(f"Cannot read {name!r}: {error}") from error
    if not df.columns:
        raise ValidationError(f"{name!r} holds no columns")
    return df


def _lines(spark: SparkSession, files: str | list[str], encoding: str) -> DataFrame:
    return spark.read.option("encoding", encoding).text(files)


def _open_quote(line: Column) -> Column:
    """Whether a line has an odd number of quotes: a cell is open at its end, or was at its start.

    A doubled quote inside a cell counts twice, so among the lines of a file the first odd one ends inside a cell.
    """
    return (F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1


def _file_name():
    # the engine gives names as URIs
    return F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))


def _facts(spark: SparkSession, path: str | list[str], encoding: str | None) -> tuple[str, set[str]]:
    """The encoding, and the files that have cells with line breaks, found in one pass over the text."""
    line = F.col("value")
    broken = ~F.is_valid_utf8(line) if encoding is None else F.lit(False)
    seen = _lines(spark, path, encoding or "UTF-8").select(
        broken.alias("broken"), F.when(_open_quote(line), _file_name()).alias("file")
    )
    # at most one entry per file and task
    found = seen.agg(F.coalesce(F.bool_or("broken"), F.lit(False)).alias("broken"), F.collect_set("file").alias("files")).first()
    return encoding or ("ISO-8859-1" if found["broken"] else "UTF-8"), set(found["files"])


def _whole_header(spark: SparkSession, file: str, sep: str, encoding: str) -> list[str]:
    """The cells of a header row that spans lines."""
    n = 2
    while True:
        # lines of one file come in order from `limit`
        lines = [r["value"] for r in _lines(spark, file, encoding).limit(n).collect()]
        row = next(csv.reader(io.StringIO("\n".join(lines).lstrip("\ufeff")), delimiter=sep))
        used = sum(cell.count("\n") for cell in row) + 1
        if used < n or len(lines) < n:
            return row
        n *= 2


def _headers(
    spark: SparkSession, path: str | list[str], sep: str, encoding: str, multiline: set[str]
) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """Each different header row, and whether cells have line breaks, with the files; empty files have none."""
    text = _lines(spark, path, encoding)
    files = [unquote(f) for f in text.inputFiles()]
    if len(files) == 1:
        first = [(files[0], r["value"]) for r in text.limit(1).collect()]
    else:
        # a file's first line has the smallest number among its lines: the split that holds it comes first
        line = text.select(_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("id"))
        begins = line.withColumn("at", F.input_file_block_start()).where("at = 0").groupBy("file")
        first = [(r["file"], r["value"]) for r in begins.agg(F.min_by("value", "id").alias("value")).collect()]
    found: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file, value in sorted(first):
        if value.strip():
            if value.count('"') % 2:
                names = _whole_header(spark, file, sep, encoding)
            else:
                names = next(csv.reader([value.lstrip("\ufeff")], delimiter=sep))
            found.setdefault((tuple(names), file in multiline), []).append(file)
    if not found:
        raise ValidationError(f"No header row in {path!r}")
    return found


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Delimited text with a header row, every column as text.

    Rows with too many cells are skipped, rows with too few are padded with
    NULL.  Without an ``encoding`` the file is read as UTF-8, or as ISO-8859-1
    if some bytes are not valid UTF-8.  Line breaks inside quotes belong to
    their cell: files where a line ends inside quotes are read whole, one task
    each, all others in splits.  Both are found in one pass over the text;
    naming the encoding and ``multiline`` (for all files) saves it.  Files of a
    folder may order their columns differently; files with other columns are
    an error.
    """
    whole: set[str] = set()
    if encoding is None or multiline is None:
        encoding, whole = _facts(spark, path, encoding)
    if multiline is not None:
        whole = {unquote(f) for f in _lines(spark, path, encoding).inputFiles()} if multiline else set()
    headers = _headers(spark, path, sep, encoding, whole)
    orders = [dedupe_columns(list(h)) for h, _ in headers]
    if any(sorted(o) != sorted(orders[0]) for o in orders):
        raise ValidationError(f"The files in {path!r} have different columns")
    parts = [
        _read_files(spark, path if len(headers) == 1 else files, names, sep, encoding, split_cells)
        for names, ((_, split_cells), files) in zip(orders, headers.items(), strict=True)
    ]
    return reduce(DataFrame.unionByName, parts)


def _read_files(
    spark: SparkSession, path: str | list[str], names: list[str], sep: str, encoding: str, multiline: bool
) -> DataFrame:
    """Files of one header row."""
    surplus = "_surplus_cells"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, surplus]])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("maxCharsPerColumn", -1)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    kept = raw.filter(col(surplus).isNull())
    return kept.select([F.when(~col(n).isin(CSV_NULLS), col(n)).alias(n) for n in names])


def flatten_structs(df: DataFrame) -> DataFrame:
    """Replace each struct column by its leaves, named with dots; lists and maps stay as they are."""

    def leaves(prefix: str, value, kind):
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                yield from leaves(f"{prefix}.{field.name}", value.getField(field.name), field.dataType)
        else:
            yield value.alias(prefix)

    return df.select([leaf for f in df.schema.fields for leaf in leaves(f.name, col(f.name), f.dataType)])


def _one_object_per_line(spark: SparkSession, path: str) -> bool:
    """Whether some file begins with two lines that are an object each; a file of one line is a document."""
    text = spark.read.text(path)
    lines = text.select(_file_name().alias("file"), F.trim("value").alias("value")).where("value != ''")
    begin = [r["file"] for r in lines.limit(1).collect()]
    if not begin:
        return False
    first = [r["value"] for r in spark.read.text(begin[0]).where(F.trim("value") != "").limit(2).collect()]
    try:
        return len(first) == 2 and all(isinstance(json.loads(line), dict) for line in first)
    except ValueError:
        return False


def read_json(
    spark: SparkSession, path: str, record_path: str | None = None, lines: bool | None = None
) -> DataFrame:
    """JSON records: a root list, an object that wraps a list, or a single object.

    ``lines`` reads one object per line, which splits; otherwise each file is
    one document and read whole, so a large dataset should come as many files.
    By default the first two lines of a file decide: a whole object with another
    line behind it means one object per line, while a folder of documents of one
    line each stays a folder of documents, whose record lists are unwrapped.
    """
    if lines is None:
        lines = _one_object_per_line(spark, path)
    df = spark.read.option("multiLine", not lines).json(path)
    if "_corrupt_record" in df.columns:
        raise ValidationError(f"Invalid JSON in {path!r}")
    lists = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    }
    key = record_path or (None if lines else next((k for k in RECORD_KEYS if k in lists), None))
    if key is not None:
        if key not in lists:
            raise ValidationError(f"No list of records under {key!r}")
        df = df.select(F.inline(col(key)))
    return flatten_structs(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
