"""Exact order statistics without collecting a column.

Spark's exact ``percentile``, ``median`` and ``percentile_disc`` keep every
distinct value of the column in one aggregation buffer, which does not survive
a large column.  Here each wanted rank is bracketed by a quantile sketch, the
rows on both sides of the bracket are counted, and the bracket is narrowed
until the rows inside it are few enough to be ranked.  Every round is one scan
with constant-size partial results; counting the rows equal to the bracket
ends separately means that a value holding any share of the rows ends the
search instead of stalling it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Context, Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.config import SETTINGS
from tablescope.functions.columns import clean_number, col


_WIDE = Context(prec=80)


@dataclass
class _Search:
    """Rank ``rank`` (0-based) of ``column`` lies strictly between ``low`` and ``high``.

    Whole numbers and decimals are searched as what they are (``kind``); all else as doubles.
    """

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    answer: float | None = None
    kind: str = "double"

    def number(self) -> Column:
        return col(self.column).cast(self.kind)

    def holds(self) -> Column:
        value = self.number()
        if self.kind != "double":
            inside = value.isNotNull()
            if self.low is not None:
                inside &= value > F.lit(self.low)
            return inside if self.high is None else inside & (value < F.lit(self.high))
        low = float("-inf") if self.low is None else self.low
        high = float("inf") if self.high is None else self.high
        return (value > F.lit(low)) & (value < F.lit(high))  # NaN sorts above infinity

    def value(self) -> Column:
        return F.when(self.holds(), self.number())

    def base(self):
        """What the sketch counts from; it holds doubles, which tell large numbers apart only by their distance."""
        return next((end for end in (self.low, self.high) if end is not None), 0)

    def sketched(self) -> Column:
        if self.kind == "double":
            return self.value()
        wide = self.number().cast("decimal(20,0)") if self.kind == "long" else self.number()
        return F.when(self.holds(), (wide - F.lit(self.base())).cast("double"))

    def cut(self, sketched: float):
        """A sketched value as a number of the column's type."""
        if self.kind == "double":
            return sketched
        if self.kind == "long":
            return max(-(1 << 63), min((1 << 63) - 1, self.base() + round(sketched)))
        scale = int(self.kind[:-1].split(",")[1])
        return _WIDE.quantize(_WIDE.add(Decimal(self.base()), Decimal(sketched)), Decimal(1).scaleb(-scale))

    def settle(self, cuts: list[float], smaller: list[int], equal: list[int]) -> None:
        """Use the counts of rows below and at each cut point of the span."""
        place, inside = self.rank - self.below, self.inside
        start, low, high, end = 0, self.low, self.high, inside
        for cut, before, at in zip(cuts, smaller, equal):
            if place < before:
                high, end = cut, before
                break
            if place < before + at:
                self.answer = cut
                return
            low, start = cut, before + at
        self.low, self.high = low, high
        self.below += start
        self.inside = end - start


def _kind(df: DataFrame, column: str) -> str:
    """The type that holds the column's numbers without loss."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return kind.simpleString()
    return "long" if isinstance(kind, T.IntegralType) else "double"


def _spans(searches: list[_Search]) -> list[list[_Search]]:
    """Searches that share a column and a bracket share their aggregates."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault((s.column, s.low, s.high), []).append(s)
    return list(groups.values())


def _sketch_ends(shares: list[float], accuracy: int) -> list[float]:
    """Shares a little below and above each wanted one."""
    slack = 2.0 / accuracy
    return sorted({min(1.0, max(0.0, share + d)) for share in shares for d in (-slack, slack)})


def _narrow(
    df: DataFrame, searches: list[_Search], accuracy: int, known: dict[str, list[float]] | None = None
) -> None:
    """One sketch scan and one counting scan; each search ends or continues in a far smaller bracket.

    ``known`` saves the sketch scan: cut points per column taken beforehand.
    """
    spans = _spans(searches)
    if known is not None:
        found = {f"s{i}": known[group[0].column] for i, group in enumerate(spans)}
    else:
        sketches = []
        for i, group in enumerate(spans):
            ends = _sketch_ends([(s.rank - s.below + 0.5) / s.inside for s in group], accuracy)
            sketches.append(F.percentile_approx(group[0].sketched(), ends, accuracy).alias(f"s{i}"))
        found = df.agg(*sketches).first()

    cuts = [sorted({group[0].cut(c) for c in found[f"s{i}"]}) for i, group in enumerate(spans)]
    regions = []
    for i, group in enumerate(spans):
        value = group[0].number()
        # 2j + 1 where the value is cut j, even numbers between the cuts.
        steps = [t.cast("int") for cut in cuts[i] for t in (value >= F.lit(cut), value > F.lit(cut))]
        region = F.when(group[0].holds(), sum(steps[1:], steps[0]))
        regions.append(F.struct(F.lit(i).alias("span"), region.alias("region")))
    counted = (
        df.select(F.inline(F.array(*regions))).filter("region IS NOT NULL").groupBy("span", "region").count()
    )
    sizes = {(r["span"], r["region"]): r["count"] for r in counted.collect()}
    for i, group in enumerate(spans):
        per_region = [sizes.get((i, j), 0) for j in range(2 * len(cuts[i]) + 1)]
        upto = [0, *accumulate(per_region)]
        smaller = [upto[2 * j + 1] for j in range(len(cuts[i]))]
        equal = per_region[1::2]
        for s in group:
            s.settle(cuts[i], smaller, equal)


def _rank_inside(df: DataFrame, searches: list[_Search]) -> None:
    """Rank the rows left inside each bracket (at most ``exact_rows`` of them)."""
    spans = _spans(searches)
    picks, wanted = [], []
    for i, group in enumerate(spans):
        picks.append(F.struct(F.lit(i).alias("span"), group[0].value().alias("v")))
        places = F.array(*[F.lit(s.rank - s.below).cast("long") for s in group])
        wanted += [F.lit(i), places]
    tall = (
        df.select(F.inline(F.array(*picks)))
        .filter("v IS NOT NULL")
        .groupBy("span", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = Window.partitionBy("span").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("n").over(ordered)
    hits = (
        tall.withColumn("last", last)
        .withColumn("place", F.explode(F.create_map(*wanted)[F.col("span")]))
        .filter("place < last AND place >= last - n")
    )
    answers = {(r["span"], r["place"]): r["v"] for r in hits.select("span", "place", "v").collect()}
    for i, group in enumerate(spans):
        for s in group:
            s.answer = answers[i, s.rank - s.below]


def order_statistics(
    df: DataFrame,
    ranks: dict[str, list[int]],
    counts: dict[str, int],
    exact_rows: int | None = None,
    accuracy: int | None = None,
    known_cuts: dict[str, list[float]] | None = None,
) -> dict[str, dict[int, float]]:
    """The values at the given 0-based ranks of each column's sorted finite values.

    ``counts`` holds the number of finite values per column, ``known_cuts``
    values near the wanted ranks if the caller has taken a sketch already.
    """
    exact_rows = exact_rows or SETTINGS.exact_rows
    accuracy = accuracy or SETTINGS.sketch_accuracy
    searches = [
        _Search(c, r, counts[c], kind=_kind(df, c)) for c, rs in ranks.items() for r in sorted(set(rs))
    ]
    while True:
        wide = [s for s in searches if s.answer is None and s.inside > exact_rows]
        if not wide:
            break
        _narrow(df, wide, accuracy, known_cuts)
        known_cuts = None
    left = [s for s in searches if s.answer is None]
    for kind in sorted({s.kind for s in left}):
        _rank_inside(df, [s for s in left if s.kind == kind])
    result: dict[str, dict[int, float]] = {c: {} for c in ranks}
    for s in searches:
        result[s.column][s.rank] = s.answer
    return result


def cut_aggregates(columns: list[str], probabilities: list[float], accuracy: int | None = None) -> list[Column]:
    """Sketched cut points of each column, for a scan that a caller makes anyway."""
    accuracy = accuracy or SETTINGS.sketch_accuracy
    ends = _sketch_ends(probabilities, accuracy)
    return [F.percentile_approx(clean_number(c), ends, accuracy).alias(f"s{i}") for i, c in enumerate(columns)]


def _counts_and_cuts(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int | None
) -> tuple[dict[str, int], dict[str, list[float]]]:
    """Finite values and sketched cut points per column in one scan."""
    counted = [F.count(clean_number(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.agg(*counted, *cut_aggregates(columns, probabilities, accuracy)).first()
    counts, cuts = {}, {}
    for i, c in enumerate(columns):
        counts[c], cuts[c] = row[f"c{i}"], row[f"s{i}"] or []
    return counts, cuts


def counted_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], **limits
) -> tuple[dict[str, int], dict[str, list[float | None]]]:
    """Finite values and quantiles per column; the first scan serves both."""
    if not columns:
        return {}, {}
    counts, cuts = _counts_and_cuts(df, columns, probabilities, limits.get("accuracy"))
    return counts, _interpolated(df, columns, probabilities, counts, cuts, limits)


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    counts: dict[str, int] | None = None,
    cuts: dict[str, list[float]] | None = None,
    **limits,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns; None where a column is empty.

    ``counts`` saves a scan of small columns if the finite values are counted already, ``cuts`` one of large columns if
    their sketches are (see ``cut_aggregates``).
    """
    if counts is None:
        return counted_quantiles(df, columns, probabilities, **limits)[1]
    return _interpolated(df, columns, probabilities, counts, cuts, limits)


def _interpolated(df, columns, probabilities, counts, cuts, limits) -> dict[str, list[float | None]]:
    usable = [c for c in columns if counts[c]]
    positions = {c: [(counts[c] - 1) * p for p in probabilities] for c in usable}
    ranks = {c: [f(h) for h in hs for f in (math.floor, math.ceil)] for c, hs in positions.items()}
    found = order_statistics(df, ranks, counts, known_cuts=cuts, **limits) if usable else {}
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for c, hs in positions.items():
        ends = [(found[c][math.floor(h)], found[c][math.ceil(h)], h - math.floor(h)) for h in hs]
        result[c] = [float(low) + float(high - low) * part for low, high, part in ends]
    return result
