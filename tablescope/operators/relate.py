"""Correlations, hypothesis tests and intervals.

The cluster computes sufficient statistics; p-values are derived from them on
the driver.  Operators whose input does not meet their minimum return a row
with a ``status`` other than ``ok`` and null statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.config import SETTINGS
from tablescope.errors import ValidationError
from tablescope.functions import special
from tablescope.functions.columns import (
    clean_number,
    col,
    numeric_cols,
    pearson,
    require_columns,
    require_numeric,
    rows,
)
from tablescope.functions.normal import normal_quantile
from tablescope.operators.describe import corrected_kurtosis, corrected_skew
from tablescope.plans.frequency import cumulative_counts
from tablescope.plans.shipping import ship_by_value
from tablescope.plans.storage import materialize

_MAX_PAIR_AGGREGATES = 200


def _pearson(df: DataFrame, names: list[str]) -> list[tuple[str, str, float | None, int]]:
    """(a, b, r, pairs) for all pairs of columns, in one scan of aggregates."""
    pairs = list(combinations(names, 2))
    if len(pairs) > _MAX_PAIR_AGGREGATES:
        return _pearson_wide(df, names)
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = clean_number(a), clean_number(b)
        aggregates += [pearson(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
    row = df.agg(*aggregates).first()
    return [(a, b, row[f"r{i}"], row[f"n{i}"]) for i, (a, b) in enumerate(pairs)]


def _pearson_wide(df: DataFrame, names: list[str]) -> list[tuple[str, str, float | None, int]]:
    """The same for wide tables: matrix products per Arrow batch, added up per task and then per pair.

    Columns are centred first; cells are masked, so that each pair uses the
    rows in which both are present.
    """
    ship_by_value()
    means = df.agg(*[F.avg(clean_number(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    centred = df.select(*[(clean_number(c) - F.lit(means[i] or 0.0)).alias(f"c{i}") for i, c in enumerate(names)])
    left, right = np.triu_indices(len(names), 1)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            seen = ~np.isnan(x)
            x, m = np.where(seen, x, 0.0), seen.astype(float)
            parts = np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m, m.T @ (x * x)])
            sums = parts if sums is None else sums + parts
        if sums is not None:
            table = pd.DataFrame(sums[:, left, right].T, columns=["n", "x", "y", "xy", "xx", "yy"])
            table.insert(0, "pair", np.arange(len(left)))
            yield table

    fields = "pair long, n double, x double, y double, xy double, xx double, yy double"
    totals = centred.mapInPandas(add_up, fields).groupBy("pair").sum("n", "x", "y", "xy", "xx", "yy")
    found = []
    for pair, _, n, x, y, xy, xx, yy in sorted((r[0], *r) for r in totals.collect()):
        spread = (xx - x * x / n) * (yy - y * y / n) if n else 0.0
        r = (xy - x * y / n) / math.sqrt(spread) if spread > 0 else None
        found.append((names[left[pair]], names[right[pair]], r, int(n)))
    return found


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r, n): correlation of average ranks over the rows where both are present.

    Rows are first reduced to distinct pairs with counts, and stored, as both rankings and the final sums read them;
    ranks come from running counts over value ranges.
    """
    pairs = df.select(F.lit(0).alias("all"), clean_number(a).alias("x"), clean_number(b).alias("y")).dropna()
    counted = materialize(pairs.groupBy("all", "x", "y").agg(F.count(F.lit(1)).alias("n")))

    def deviations(value: str, output: str) -> DataFrame:
        """(value, output): the mean position of the rows that hold the value, from the middle of the ranks."""
        freq = counted.groupBy("all", value).agg(F.sum("n").alias("n"))
        placed = cumulative_counts(freq, ["all"], value)
        return placed.select(value, (F.col("before") + (F.col("n") - F.col("total")) / 2).alias(output))

    ranked = counted.join(deviations("x", "u"), "x").join(deviations("y", "v"), "y")
    u, v, n = F.col("u"), F.col("v"), F.col("n")
    sums = ranked.agg(
        F.sum(n * u * v).alias("uv"), F.sum(n * u * u).alias("uu"), F.sum(n * v * v).alias("vv"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"),
    )
    return sums.select(F.try_divide("uv", F.sqrt(F.col("uu") * F.col("vv"))).alias("r"), "n")


def _null_patterns(df: DataFrame, names: list[str]) -> list[int]:
    """For each column the number of the set of rows where it is null; 0 for none, equal numbers for equal sets.

    Sets are told apart by sums of row hashes (90 bits).
    """
    row_hash = F.xxhash64(*[clean_number(c) for c in names], *[clean_number(c).isNull() for c in names])
    aggregates = []
    for i, c in enumerate(names):
        missing = clean_number(c).isNull()
        aggregates.append(F.count_if(missing).alias(f"n{i}"))
        for k in range(3):
            part = F.shiftright(row_hash, 20 * k).bitwiseAND((1 << 20) - 1)
            aggregates.append(F.sum(F.when(missing, part * part)).cast("string").alias(f"s{i}_{k}"))
    row = df.agg(*aggregates).first()
    known: dict[tuple, int] = {(0, None, None, None): 0}
    return [known.setdefault((row[f"n{i}"], *(row[f"s{i}_{k}"] for k in range(3))), len(known)) for i in range(len(names))]


def _rankings(patterns: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Which rankings are needed, as (column, pattern of the other column), and for each pair of columns its two.

    A pair is ranked over the rows where both are present. A ranking is the same for all partners of one pattern, and
    where a partner has no nulls, or the same ones, it is the column's own.
    """
    wanted: dict[tuple[int, int], int] = {}

    def ranking(column: int, other: int) -> int:
        pattern = 0 if other == patterns[column] else other
        return wanted.setdefault((column, pattern), len(wanted))

    pairs = [
        (ranking(a, patterns[b]), ranking(b, patterns[a])) for a, b in combinations(range(len(patterns)), 2)
    ]
    return list(wanted), pairs


#: Rows whose ranks are multiplied at a time.
_RANK_BLOCK_BITS = 12


def _rank_matrix(df: DataFrame, names: list[str]) -> list[tuple[str, str, float | None, int]]:
    """(a, b, r, pairs) for all pairs of columns: correlations of average ranks.

    Every column is ranked once per pattern of nulls of its partners. Ranks come from running counts over value ranges,
    go back to their rows, and are multiplied in blocks of rows, so what is shuffled grows with the columns and not
    with their pairs.
    """
    ship_by_value()
    patterns = _null_patterns(df, names)
    wanted, pairs = _rankings(patterns)
    cells = [clean_number(c).alias(f"c{i}") for i, c in enumerate(names)]
    stored = materialize(df.select(F.monotonically_increasing_id().alias("id"), *cells))  # fixes the numbers of rows
    entries = []
    for k, (column, pattern) in enumerate(wanted):
        value = F.col(f"c{column}")
        if pattern:
            value = F.when(F.col(f"c{patterns.index(pattern)}").isNotNull(), value)
        entries.append(F.struct(F.lit(k).alias("ranking"), value.alias("value")))
    tall = stored.select("id", F.inline(F.array(*entries))).where("value IS NOT NULL")
    freq = tall.groupBy("ranking", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = cumulative_counts(freq, ["ranking"], "value")
    mean = placed.select("ranking", "value", (F.col("before") + (F.col("n") - F.col("total")) / 2).alias("u"))
    ranked = tall.join(mean, ["ranking", "value"]).select(F.shiftright("id", _RANK_BLOCK_BITS).alias("block"), "id", "ranking", "u")
    left, right = (np.array(side) for side in zip(*pairs, strict=True))
    rankings, size = len(wanted), 1 << _RANK_BLOCK_BITS

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, squares, rows_of = np.zeros(len(left)), np.zeros(rankings), np.zeros(rankings, np.int64)
        x = np.zeros((size, rankings))
        at = None

        def close() -> None:
            for k in range(0, len(left), 256):
                products[k : k + 256] += (x[:, left[k : k + 256]] * x[:, right[k : k + 256]]).sum(0)
            x[:] = 0.0

        for batch in batches:
            block, row = batch["block"].to_numpy(), batch["id"].to_numpy() & (size - 1)
            ranking, u = batch["ranking"].to_numpy(), batch["u"].to_numpy()
            rows_of += np.bincount(ranking, minlength=rankings)
            squares += np.bincount(ranking, u * u, minlength=rankings)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if at is not None and block[a] != at:
                        close()
                    at = block[a]
                    x[row[a:b], ranking[a:b]] = u[a:b]
        if at is not None:
            close()
            yield pd.DataFrame({"pair": np.arange(len(left)), "ranking": -1, "total": products, "n": 0})
            yield pd.DataFrame({"pair": -1, "ranking": np.arange(rankings), "total": squares, "n": rows_of})

    blocks = ranked.repartition("block").sortWithinPartitions("block")
    sums = blocks.mapInPandas(add_up, "pair int, ranking int, total double, n long")
    product, square, count = {}, {}, {}
    for r in sums.groupBy("pair", "ranking").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        if r["pair"] >= 0:
            product[r["pair"]] = r["total"]
        else:
            square[r["ranking"]], count[r["ranking"]] = r["total"], r["n"]
    found = []
    for k, (a, b) in enumerate(combinations(names, 2)):
        spread = square.get(pairs[k][0], 0.0) * square.get(pairs[k][1], 0.0)
        found.append((a, b, product[k] / math.sqrt(spread) if spread > 0 else None, count.get(pairs[k][0], 0)))
    return found


def pair_correlations(df: DataFrame, method: str = "pearson", columns: list[str] | None = None):
    names = numeric_cols(df) if columns is None else columns
    if method == "pearson":
        return _pearson(df, names)
    if method == "spearman":
        return _rank_matrix(df, names) if len(names) > 1 else []
    raise ValidationError(f"Unknown correlation method {method!r}")


def correlation_matrix(
    df: DataFrame, method: str = "pearson", columns: list[str] | None = None, digits: int = 3
) -> DataFrame:
    """(a, b, r) for every ordered pair, the diagonal included; empty below two numeric columns."""
    names = numeric_cols(df) if columns is None else columns
    schema = "a string, b string, r double"
    if len(names) < 2:
        return rows(df.sparkSession, [], schema)
    cells = {(c, c): 1.0 for c in names}
    for a, b, r, _ in pair_correlations(df, method, names):
        cells[a, b] = cells[b, a] = None if r is None else round(r, digits)
    return rows(df.sparkSession, [(a, b, cells[a, b]) for a in names for b in names], schema)


def strength_of(r: float) -> str:
    if abs(r) >= SETTINGS.correlation_strong:
        return "strong"
    return "moderate" if abs(r) >= SETTINGS.correlation_moderate else "weak"


def significant_correlations(
    df: DataFrame,
    method: str = "pearson",
    columns: list[str] | None = None,
    min_abs_r: float | None = None,
) -> DataFrame:
    """Pairs with at least five rows and a correlation of moderate size, strongest first."""
    floor = SETTINGS.correlation_moderate if min_abs_r is None else min_abs_r
    found = [
        (a, b, round(r, 3), special.correlation_p_value(r, n), n, strength_of(r), "positive" if r > 0 else "negative")
        for a, b, r, n in pair_correlations(df, method, columns)
        if r is not None and n >= 5 and abs(r) >= floor
    ]
    found.sort(key=lambda row: -abs(row[2]))
    return rows(
        df.sparkSession,
        found,
        "feature_1 string, feature_2 string, r double, p_value double, n long, strength string, direction string",
    )


_NORMALITY_SCHEMA = (
    "test string, status string, n long, w double, z double, p_value double, significant boolean, "
    "skew double, kurtosis double, moment_statistic double, moment_p_value double"
)

# Coefficients of Royston (1995), "Remark AS R94", highest power first.
_ROYSTON_LAST = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157]
_ROYSTON_SECOND = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981]
_ROYSTON_LARGE_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]
_ROYSTON_LARGE_LOG_SD = [0.0030302, -0.082676, -0.4803]
_ROYSTON_SMALL_MEAN = [-0.0006714, 0.025054, -0.39978, 0.5440]
_ROYSTON_SMALL_LOG_SD = [-0.0020322, 0.062767, -0.77857, 1.3822]


def _poly(coefficients: list[float], x: float) -> float:
    value = 0.0
    for c in coefficients:
        value = value * x + c
    return value


def wilk_weights(n: int) -> tuple[float, float, float]:
    """What turns normal scores into the weights of Shapiro and Wilk for ``n`` values (eight or more).

    The weights of the largest and the second largest value, and the factor of the scores of all others.
    """
    m = [special.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    norm = sum(v * v for v in m)
    u = 1.0 / math.sqrt(n)
    last = m[-1] / math.sqrt(norm) + u * _poly(_ROYSTON_LAST, u)
    second = m[-2] / math.sqrt(norm) + u * _poly(_ROYSTON_SECOND, u)
    scale = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    return last, second, 1.0 / math.sqrt(scale)


def _wilk_z(w: float, n: int) -> float:
    """Standard normal under normality; large values speak against it."""
    if n >= 12:
        log_n = math.log(n)
        mean_z, sd_z = _poly(_ROYSTON_LARGE_MEAN, log_n), math.exp(_poly(_ROYSTON_LARGE_LOG_SD, log_n))
        return (math.log1p(-w) - mean_z) / sd_z
    mean_z, sd_z = _poly(_ROYSTON_SMALL_MEAN, n), math.exp(_poly(_ROYSTON_SMALL_LOG_SD, n))
    return (-math.log(0.459 * n - 2.273 - math.log1p(-w)) - mean_z) / sd_z


def _francia_z(w: float, n: int) -> float:
    """As ``_wilk_z``, after Royston (1993)."""
    log_n = math.log(n)
    log_log = math.log(log_n)
    return (math.log1p(-w) - (-1.2725 + 1.0521 * (log_log - log_n))) / (1.0308 - 0.26758 * (log_log + 2.0 / log_n))


def francia_norm(n: int, single: int = 20_000) -> float:
    """Sum of the squared normal scores of all ranks.

    The ``single`` outermost ranks of each side are summed one by one. Between them the sum is the integral of the
    squared quantile, which has a closed form.
    """
    size = n + 0.25

    def edge(i: int) -> float:
        """Quantile between the ranks i and i + 1 (from 0), in the lower half for accuracy."""
        return special.normal_quantile((i + 0.125) / size)

    outer = min(single, n // 2)
    z = [edge(i) for i in range(outer + 1)]
    scores = [size * (special.normal_density(a) - special.normal_density(b)) for a, b in zip(z, z[1:])]
    total = 2.0 * sum(v * v for v in scores)
    inner = n - 2 * outer
    if inner == 1:  # the middle rank
        return total
    if inner > 1:
        low = z[-1]
        total += size * ((1.0 - 2.0 * special.normal_upper(-low)) + 2.0 * low * special.normal_density(low))
    return total


def _run_scores(before, count, n: int):
    """Sum of the normal scores of a run of equal values: a difference of densities."""

    def density(ranks):
        z = normal_quantile((ranks + 0.125) / F.lit(n + 0.25))
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    return F.lit(n + 0.25) * (density(before) - density(before + count))


def normality_test(df: DataFrame, column: str) -> DataFrame:
    """Tests of normality on all rows: a W statistic, and the moment test.

    Up to ``wilk_rows`` values W is that of Shapiro and Wilk; beyond, where their weights are not defined, it is that of
    Shapiro and Francia, the squared correlation of the values with their normal scores. Equal values share a run of
    ranks, whose scores have a closed form, so the test needs only counts of distinct values. The p-value beyond
    5000 values extrapolates its published range. A constant column has W = 1. Too few values give a status.
    """
    require_numeric(df, column)
    values = df.select(clean_number(column).alias("v")).dropna()
    whole = values.agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"),
        F.skewness("v").alias("s"), F.kurtosis("v").alias("k"),
    ).first()
    n, s, k = whole["n"], whole["s"], whole["k"]
    if n < 8:
        return rows(df.sparkSession, [("shapiro-wilk", "insufficient_data", n) + (None,) * 8], _NORMALITY_SCHEMA)
    spread = whole["var"] * n
    freq = values.groupBy(F.lit(0).alias("all"), "v").agg(F.count(F.lit(1)).alias("n"))
    placed = cumulative_counts(freq, ["all"], "v")
    centred = F.col("v") - F.lit(whole["m"])
    exact = n <= SETTINGS.wilk_rows
    if spread == 0.0:
        w = 1.0
    elif exact:
        last, second, factor = wilk_weights(n)
        rank = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n")))
        ranked = placed.select(centred.alias("x"), rank.alias("i"))
        i = F.col("i")
        weight = F.lit(factor) * normal_quantile((i - 0.375) / F.lit(n + 0.25))
        ends = {1: -last, 2: -second, n - 1: second, n: last}
        for at, value in ends.items():
            weight = F.when(i == at, F.lit(value)).otherwise(weight)
        w = min(1.0, ranked.agg(F.sum(weight * F.col("x")).alias("b")).first()["b"] ** 2 / spread)
    else:
        b = placed.agg(F.sum(centred * _run_scores(F.col("before"), F.col("n"), n)).alias("b")).first()["b"]
        w = min(1.0, b * b / (spread * francia_norm(n)))
    z = -math.inf if w == 1.0 else (_wilk_z(w, n) if exact else _francia_z(w, n))
    p = 1.0 if w == 1.0 else special.normal_upper(z)
    moment = None if s is None else n / 6.0 * (s * s + k * k / 4.0)
    return rows(
        df.sparkSession,
        [(
            "shapiro-wilk" if exact else "shapiro-francia", "ok", n, w, None if w == 1.0 else z, p, p < SETTINGS.alpha,
            corrected_skew(s, n), corrected_kurtosis(k, n),
            moment, None if moment is None else special.chi2_upper(moment, 2),
        )],
        _NORMALITY_SCHEMA,
    )


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """(level, n, mean, variance) of a numeric column per level, nulls left out."""
    require_numeric(df, value)
    require_columns(df, group)
    return (
        df.filter(col(group).isNotNull() & col(value).isNotNull())
        .select(col(group).alias("level"), clean_number(value).alias("v"))
        .dropna()
        .groupBy("level")
        .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))
    )


_TEST_SCHEMA = "test string, status string, statistic double, dof double, p_value double, significant boolean"


def t_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Welch's test between exactly two levels, the smaller level first."""
    levels = group_moments(df, value, group).orderBy("level").limit(3).collect()
    if len(levels) != 2 or min(r["n"] for r in levels) < 2:
        status = "needs_two_levels" if len(levels) != 2 else "insufficient_data"
        return rows(df.sparkSession, [("welch-t", status, None, None, None, None)], _TEST_SCHEMA)
    first, second = levels
    e1, e2 = first["variance"] / first["n"], second["variance"] / second["n"]
    gap = first["mean"] - second["mean"]
    if e1 + e2 == 0.0:
        t = math.copysign(math.inf, gap) if gap else 0.0
        dof = float(first["n"] + second["n"] - 2)
    else:
        t = gap / math.sqrt(e1 + e2)
        dof = (e1 + e2) ** 2 / (e1**2 / (first["n"] - 1) + e2**2 / (second["n"] - 1))
    p = special.t_two_sided(t, dof)
    return rows(df.sparkSession, [("welch-t", "ok", t, dof, p, p < SETTINGS.alpha)], _TEST_SCHEMA)


def anova_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way F test over the levels with at least two rows; any number of levels."""
    levels = materialize(group_moments(df, value, group).filter("n >= 2"))
    row = levels.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.col("variance")).alias("within"),
    ).first()
    schema = "test string, status string, statistic double, dof_between long, dof_within long, p_value double, significant boolean"
    if row["k"] < 2:
        return rows(df.sparkSession, [("anova", "insufficient_data") + (None,) * 5], schema)
    between = levels.agg(F.sum(F.col("n") * (F.col("mean") - F.lit(row["grand"])) ** 2).alias("b")).first()["b"]
    d1, d2 = row["k"] - 1, row["n"] - row["k"]
    f = math.inf if row["within"] == 0.0 else (between / d1) / (row["within"] / d2)
    p = special.f_upper(f, d1, d2)
    return rows(df.sparkSession, [("anova", "ok", f, d1, d2, p, p < SETTINGS.alpha)], schema)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): contingency counts in long form, rows with a null left out."""
    require_columns(df, a, b)
    return (
        df.select(col(a).alias("a"), col(b).alias("b"))
        .dropna()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories; Yates' correction on a 2 x 2 table.

    Empty cells are accounted for through the margins, since a sum over all
    cells of (o - e)^2 / e needs o only where it is not zero.
    """
    cells = materialize(crosstab(df, a, b))
    by_a = cells.groupBy("a").agg(F.sum("n").alias("na"))
    by_b = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    size = cells.agg(F.sum("n").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c")).first()
    n, r, c = size["n"], size["r"], size["c"]
    schema = "test string, status string, statistic double, dof long, p_value double, significant boolean"
    if r < 2 or c < 2:
        return rows(df.sparkSession, [("chi-square", "needs_two_by_two", None, None, None, None)], schema)
    dof = (r - 1) * (c - 1)
    observed = cells.join(by_a, "a").join(by_b, "b")
    expected = F.col("na").cast("double") * F.col("nb") / F.lit(float(n))
    if dof == 1:
        margins_a = [x["na"] for x in by_a.collect()]
        margins_b = [x["nb"] for x in by_b.collect()]
        row = observed.agg(F.max(F.abs(F.col("n") - expected)).alias("gap")).first()
        # In a 2 x 2 table all four cells are equally far from their expectation.
        gap = row["gap"]
        gap -= min(0.5, gap)
        statistic = sum(gap * gap / (x * y / n) for x in margins_a for y in margins_b)
    else:
        # sum (o - e)^2 / e = sum o^2 / e - n
        row = observed.agg(F.sum(F.col("n").cast("double") * F.col("n") / expected).alias("s")).first()
        statistic = row["s"] - n
    p = special.chi2_upper(statistic, dof)
    return rows(df.sparkSession, [("chi-square", "ok", statistic, dof, p, p < SETTINGS.alpha)], schema)


def confidence_interval(df: DataFrame, column: str, level: float | None = None) -> DataFrame:
    """One row (n, mean, low, high) of the t interval for the mean, four decimals."""
    require_numeric(df, column)
    level = SETTINGS.confidence_level if level is None else level
    value = clean_number(column)
    row = df.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    schema = "status string, n long, mean double, low double, high double"
    if row["n"] < 2:
        return rows(df.sparkSession, [("insufficient_data", row["n"], None, None, None)], schema)
    half = special.t_quantile(0.5 + level / 2, row["n"] - 1) * row["s"] / math.sqrt(row["n"])
    m = row["m"]
    return rows(df.sparkSession, [("ok", row["n"], round(m, 4), round(m - half, 4), round(m + half, 4))], schema)


def regression_diagnostics(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x with fit, significance and residual spread, four decimals."""
    require_numeric(df, x)
    require_numeric(df, y)
    a, b = clean_number(x), clean_number(y)
    row = df.agg(
        F.regr_count(b, a).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        pearson(b, a).alias("r"),
        F.regr_sxx(b, a).alias("sxx"),
        F.regr_syy(b, a).alias("syy"),
    ).first()
    schema = (
        "status string, n long, slope double, intercept double, r_squared double, p_value double, "
        "std_err double, residual_mean double, residual_std double"
    )
    n = row["n"]
    if n < 5 or not row["sxx"]:
        return rows(df.sparkSession, [("insufficient_data", n) + (None,) * 7], schema)
    r = 0.0 if row["r"] is None else min(1.0, max(-1.0, row["r"]))  # rounding may carry an exact line beyond 1
    sse = row["syy"] * max(0.0, 1.0 - r * r)
    rest = df.agg(F.avg(b - (F.lit(row["slope"]) * a + F.lit(row["intercept"]))).alias("mean")).first()["mean"]
    std_err = math.sqrt(sse / (n - 2) / row["sxx"])
    return rows(
        df.sparkSession,
        [(
            "ok", n, round(row["slope"], 4), round(row["intercept"], 4), round(r * r, 4),
            special.correlation_p_value(r, n), round(std_err, 4), round(rest, 4) + 0.0, round(math.sqrt(sse / (n - 1)), 4),
        )],
        schema,
    )
