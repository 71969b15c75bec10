import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.errors import CheckpointDirError
from tablescope.plans import frequency, ordered, quantiles, storage


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, the rest are spread over many magnitudes."""
    rng = np.random.default_rng(1)
    spread = np.concatenate([np.full(4_000, 7.0), rng.lognormal(3, 3, 4_000), rng.normal(0, 1e-6, 4_000)])
    rng.shuffle(spread)
    return spark.createDataFrame([(float(v), int(i % 5)) for i, v in enumerate(spread)], "x double, g int"), spread


@pytest.mark.parametrize("exact_rows, accuracy", [(100_000, 1_000), (50, 20), (1, 10)])
def test_order_statistics_match_a_full_sort(skewed, exact_rows, accuracy):
    df, x = skewed
    ordered_x = np.sort(x)
    ranks = [0, 1, 3_999, 4_000, 6_000, 7_999, 8_000, 11_998, 11_999]
    found = quantiles.order_statistics(df, {"x": ranks}, {"x": len(x)}, exact_rows=exact_rows, accuracy=accuracy)
    assert [found["x"][r] for r in ranks] == [ordered_x[r] for r in ranks]


@pytest.mark.parametrize("kind", ["bigint", "decimal(30,2)"])
def test_order_statistics_keep_every_digit(spark, kind):
    base = 2**60 + 1
    df = spark.range(2_000).selectExpr(f"CAST(CAST({base} AS {kind}) + (id * 7) % 2000 AS {kind}) AS x")
    ranks = [0, 1, 20, 1_000, 1_979, 1_999]
    found = quantiles.order_statistics(df, {"x": ranks}, {"x": 2_000}, exact_rows=50, accuracy=20)
    assert [int(found["x"][r]) for r in ranks] == [base + r for r in ranks]


def test_cumulative_counts_keep_whole_numbers_apart(spark):
    freq = spark.range(500).selectExpr(f"{2**60} + id AS x", "1L AS n")
    placed = frequency.cumulative_counts(freq, [], "x", 50).collect()
    assert sorted((r["x"] - 2**60, r["before"]) for r in placed) == [(i, i) for i in range(500)]


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (2.0,), (float("inf"),)], "x double")
    assert quantiles.quantiles(df, ["x"], [0.5]) == {"x": [1.5]}
    assert quantiles.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.floats(0, 1))
def test_quantiles_interpolate_linearly(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").coalesce(1)
    got = quantiles.quantiles(df, ["x"], [p], exact_rows=3, accuracy=10)["x"][0]
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("bucket_rows", [10_000_000, 100])
def test_cumulative_counts(skewed, bucket_rows):
    df, _ = skewed
    freq = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    placed = frequency.cumulative_counts(freq, ["g"], "x", bucket_rows)
    rows = placed.collect()
    data = [(r["g"], r["x"]) for r in df.collect()]
    by_group = {g: np.sort([v for k, v in data if k == g]) for g in range(5)}
    assert len(rows) == freq.count()
    for r in rows[::37]:
        assert r["before"] == np.searchsorted(by_group[r["g"]], r["x"]) and r["total"] == len(by_group[r["g"]])


def test_group_quantiles(skewed):
    df, _ = skewed
    freq = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    got = {r["g"]: (r["q0"], r["q1"]) for r in frequency.group_quantiles(freq, ["g"], "x", [0.1, 0.75]).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx((part.x.quantile(0.1), part.x.quantile(0.75)))


def test_value_frequencies_keep_types_apart(spark):
    df = spark.createDataFrame([(1, 1.0, "1"), (1, float("nan"), "1"), (None, 2.5, None)], "i int, d double, s string")
    found = frequency.value_frequencies(df, ["i", "d", "s"]).collect()
    assert sorted((r["column"], r["whole"], r["real"], r["value"], r["n"]) for r in found if r["column"] != "d") == [
        ("i", 1, None, None, 2), ("s", None, None, "1", 2),
    ]
    assert frequency.distinct_counts(df, ["i", "d", "s"]) == {"i": 1, "d": 2, "s": 1}


def test_few_valued(spark):
    df = spark.range(1000).selectExpr("CAST(id AS STRING) AS many", "CAST(nullif(id % 3, 2) AS STRING) AS few")
    found = frequency.few_valued(df, ["many", "few"], 20)
    assert found == {"few": {"0": 334, "1": 333, None: 333}}


def test_positions_are_consecutive(spark):
    df = spark.range(0, 3_000, 1, 6).selectExpr("id", "id % 3 AS k", "hash(id) AS h")
    placed = ordered.with_positions(df, ["k", "h"]).orderBy("_pos").collect()
    assert [r["_pos"] for r in placed] == list(range(3_000))
    assert [(r["k"], r["h"]) for r in placed] == sorted((r["k"], r["h"]) for r in placed)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_split_windows_equal_plain_windows(spark, keys):
    df = spark.range(0, 2_000, 1, 4).selectExpr(
        "id", "CASE WHEN id % 3 > 0 THEN 0 ELSE id % 7 END AS k", "hash(id) AS h", "CAST(id * 7 % 13 AS DOUBLE) AS y"
    )

    def columns(spec):
        return {"back": F.lag("y", 3).over(spec), "mean": F.avg("y").over(spec.rowsBetween(-3, 0))}

    plain = ordered.over_order(df, ["h", "id"], keys, 3, columns)
    split = ordered.over_order(df, ["h", "id"], keys, 3, columns, hot_group_rows=10, block_rows=50)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(plain.columns).collect()))


class Session:
    """The parts of a session that the choice of a folder looks at."""

    def __init__(self, master, setting=None):
        self.conf = self.sparkContext = self
        self.master, self.setting, self.folder = master, setting, None

    def get(self, key, default):
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session():
    assert storage.shared_folder(Session("yarn", "hdfs://shared/")) == "hdfs://shared"
    assert storage.shared_folder(Session("local[2]", "/named")) == "/named"
    with pytest.raises(CheckpointDirError):
        storage.shared_folder(Session("yarn"))
    local = Session("local[2]")
    assert storage.shared_folder(local) == local.folder


def test_materialize(spark):
    df = spark.range(5).withColumn("t", F.lit("2024-01-01").cast("timestamp_ntz"))
    stored = storage.materialize(df)
    assert stored.schema == df.schema or stored.dtypes == df.dtypes
    assert stored.count() == 5
