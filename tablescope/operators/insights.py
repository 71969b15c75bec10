"""Rule-based insight rows (section, ord, subject, metric, value, message)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablescope.functions.columns import categorical_cols, datetime_cols, numeric_cols, rows
from tablescope.operators.describe import moments
from tablescope.operators.outliers import outlier_summary
from tablescope.operators.profile import GENERIC, detect_domain, profile_summary
from tablescope.operators.relate import significant_correlations
from tablescope.operators.semantics import column_profile

SECTIONS = ["executive_summary", "key_findings", "business_risks", "opportunities", "recommendations", "action_plan"]

_SCHEMA = "section string, ord int, subject string, metric string, value double, message string"
# The thresholds of the rules.
GRADES = {"excellent": 85, "good": 70, "fair": 50, "poor": 0}
SKEWED = 1.0
SKEW_ROWS = 5
MISSING_FROM, MISSING_TO = 20, 60
COMPLETE_ENOUGH, COMPLETE_FOR_MODELS = 80, 90
REPEATED_SHARE = 0.02
OUTLIER_PCT, OUTLIER_ROWS = 5, 10


@dataclass
class Facts:
    """What the rules look at; gathered once and shared by all sections.

    ``pairs``, ``keywords`` and ``lines`` shorten the report: pairs of columns that correlate, words of the domain, and
    rows of a section; by default all are told.
    """

    df: DataFrame
    summary: dict
    columns: list[dict]
    domain: dict
    pairs: int | None = None
    keywords: int | None = None
    lines: int | None = None

    @property
    def duplicate_share(self) -> float:
        return self.summary["duplicate_rows"] / max(self.summary["rows"], 1)


def gather_facts(df: DataFrame, **limits) -> Facts:
    """Profile, column profile and domain; the stored rows are bounded by the number of columns."""
    wanted = ["ord", "column", "kind", "n_rows", "n_missing", "n_infinite", "n_unique", "n_lowered", "semantic_type", "missing_pct"]
    found = [r.asDict() for r in column_profile(df).select(*wanted).collect()]
    found.sort(key=lambda r: r["ord"])
    stored = df.sparkSession.createDataFrame(
        [tuple(r[w] for w in wanted) for r in found],
        "ord int, column string, kind string, n_rows long, n_missing long, n_infinite long, n_unique long, "
        "n_lowered long, semantic_type string, missing_pct double",
    )
    return Facts(df, profile_summary(df, stored), found, detect_domain(df).first().asDict(), **limits)


@dataclass(frozen=True)
class Rule:
    """A section, what of the facts it looks at, and the sentence that goes with each hit.

    ``hits`` gives (subject, metric, value, words for the sentence); a rule without hits is silent, unless it is the
    section's ``otherwise``, which speaks when nothing else has.
    """

    section: str
    hits: Callable[[Facts], Iterable[tuple]]
    sentence: str
    otherwise: bool = False


def _table(metric: str, value, when: bool = True, **words) -> list[tuple]:
    return [("table", metric, value, words)] if when else []


def _correlations(f: Facts) -> Iterator[tuple]:
    if len(numeric_cols(f.df)) >= 2:
        found = significant_correlations(f.df)
        for r in (found if f.pairs is None else found.limit(f.pairs)).collect():  # one row per pair of columns at most
            yield f"{r['feature_1']}, {r['feature_2']}", "r", r["r"], {"how": f"{r['strength']} {r['direction']}"}


def _skewed(f: Facts) -> Iterator[tuple]:
    for name, m in moments(f.df, numeric_cols(f.df)).items():
        if m["count"] >= SKEW_ROWS and abs(m["skew"] or 0.0) > SKEWED:
            yield name, "skew", round(m["skew"], 2), {"side": "high" if m["skew"] > 0 else "low"}


def _outliers(f: Facts) -> Iterator[tuple]:
    if f.summary["rows"] >= OUTLIER_ROWS and numeric_cols(f.df):
        worst = outlier_summary(f.df).first()
        if worst is not None and worst["pct"] > OUTLIER_PCT:
            yield worst["column"], "outlier_pct", worst["pct"], {}


def _columns_where(metric: str, test: Callable[[dict], bool]) -> Callable[[Facts], list[tuple]]:
    return lambda f: [(c["column"], metric, c[metric], {}) for c in f.columns if test(c)]


def _kind(kind: str, names: Callable[[DataFrame], list[str]], least: int = 1) -> Callable[[Facts], list[tuple]]:
    def hits(f: Facts) -> list[tuple]:
        n = len(names(f.df))
        return [(kind, "columns", n, {})] if n >= least else []

    return hits


def _quality(part: str) -> Callable[[Facts], list[tuple]]:
    return lambda f: [("quality", part, f.summary[part], {})]


def _grade(f: Facts) -> list[tuple]:
    score = f.summary["overall"]
    return [("quality", "overall", score, {"grade": next(g for g, least in GRADES.items() if score >= least)})]


def _domain(f: Facts) -> list[tuple]:
    d = f.domain
    words = {"words": ", ".join((d["keywords"] or [])[: f.keywords])}
    return [(d["domain"], "hits", d["hits"], words)] if d["domain"] != GENERIC else []


def _steps(*steps: tuple[Callable[[Facts], bool], str]) -> Callable[[Facts], list[tuple]]:
    def hits(f: Facts) -> list[tuple]:
        due = [text for when, text in steps if when(f)]
        return [("table", "step", i, {"text": text}) for i, text in enumerate(due, 1)]

    return hits


def _nothing(f: Facts) -> list[tuple]:
    return [("table", None, None, {})]


RULES = [
    Rule("executive_summary", lambda f: _table("rows", f.summary["rows"]), "number of rows: {value:,.0f}"),
    Rule("executive_summary", lambda f: _table("columns", f.summary["columns"]), "number of columns: {value:.0f}"),
    Rule(
        "executive_summary",
        lambda f: [("domain", "confidence", f.domain["confidence"], {"name": f.domain["domain"]})],
        "the column names point to {name}",
    ),
    Rule("executive_summary", _grade, "overall quality: {grade}"),
    *[
        Rule("executive_summary", _quality(p), "{metric} scores {value} of 100")
        for p in ("completeness", "uniqueness", "consistency", "validity")
    ],
    *[
        Rule("executive_summary", lambda f, k=k: [("columns", k, f.summary[f"{k}_columns"], {})], "{metric} columns: {value:.0f}")
        for k in ("numeric", "categorical", "datetime")
    ],
    Rule("key_findings", _correlations, "{how} relation"),
    Rule("key_findings", _skewed, "stretches far to the {side} side"),
    Rule(
        "key_findings",
        lambda f: _table("duplicate_rows", f.summary["duplicate_rows"], f.summary["duplicate_rows"] > 0, share=f.duplicate_share),
        "rows seen before: {share:.1%}",
    ),
    Rule(
        "key_findings",
        _columns_where("missing_pct", lambda c: MISSING_FROM < c["missing_pct"] <= MISSING_TO),
        "{value}% of the cells are empty",
    ),
    Rule("key_findings", _nothing, "nothing unusual", otherwise=True),
    Rule(
        "business_risks",
        lambda f: _table("completeness", f.summary["completeness"], f.summary["completeness"] < COMPLETE_ENOUGH),
        "what is missing may differ from what is there",
    ),
    Rule(
        "business_risks",
        lambda f: _table("duplicate_rows", f.summary["duplicate_rows"], f.duplicate_share > REPEATED_SHARE),
        "sums and counts may be too high",
    ),
    Rule("business_risks", _outliers, "extreme values may dominate the means"),
    Rule("business_risks", _columns_where("n_unique", lambda c: c["semantic_type"] == "mixed"), "several formats in one column"),
    Rule("business_risks", _nothing, "no risk found", otherwise=True),
    Rule("opportunities", _kind("numeric", numeric_cols, 2), "numbers to model against one another"),
    Rule("opportunities", _kind("datetime", datetime_cols), "dates to forecast along"),
    Rule("opportunities", _kind("categorical", categorical_cols), "groups to compare"),
    Rule("opportunities", _domain, "measures of this field to begin with: {words}"),
    Rule("opportunities", _nothing, "more features are needed first", otherwise=True),
    Rule(
        "recommendations",
        lambda f: _table("completeness", f.summary["completeness"], f.summary["completeness"] < COMPLETE_FOR_MODELS),
        "fill or drop the emptiest columns before a model is trained",
    ),
    Rule(
        "recommendations",
        lambda f: _table("duplicate_rows", f.summary["duplicate_rows"], f.summary["duplicate_rows"] > 0),
        "drop rows seen before unless they are separate events",
    ),
    Rule(
        "recommendations",
        lambda f: _table("high_cardinality_columns", n := f.summary["high_cardinality_columns"], n > 0),
        "keep identifiers out of the features",
    ),
    Rule("recommendations", _nothing, "repeat this report whenever the data changes"),
    Rule(
        "action_plan",
        _steps(
            (lambda f: True, "clean: fill gaps, drop repeats"),
            (lambda f: True, "review: rows that detect_anomalies flags"),
            (lambda f: bool(numeric_cols(f.df) and categorical_cols(f.df)), "compare: numbers between groups"),
            (lambda f: bool(datetime_cols(f.df)), "forecast: the coming period"),
            (lambda f: True, "share: the cleaned table and this report"),
        ),
        "{text}",
    ),
]


def _sections(facts: Facts, names: list[str]) -> DataFrame:
    data = []
    for name in names:
        lines: list[tuple] = []
        for rule in (r for r in RULES if r.section == name):
            if rule.otherwise and lines:
                continue
            for subject, metric, value, words in rule.hits(facts):
                number = None if value is None else float(value)
                message = rule.sentence.format(**{"subject": subject, "metric": metric, "value": number, **words})
                lines.append((subject, metric, number, message))
        data += [(name, i, *line) for i, line in enumerate(lines[: facts.lines], 1)]
    return rows(facts.df.sparkSession, data, _SCHEMA)


def executive_summary(facts: Facts) -> DataFrame:
    return _sections(facts, ["executive_summary"])


def key_findings(facts: Facts) -> DataFrame:
    return _sections(facts, ["key_findings"])


def business_risks(facts: Facts) -> DataFrame:
    return _sections(facts, ["business_risks"])


def opportunities(facts: Facts) -> DataFrame:
    return _sections(facts, ["opportunities"])


def recommendations(facts: Facts) -> DataFrame:
    return _sections(facts, ["recommendations"])


def action_plan(facts: Facts) -> DataFrame:
    return _sections(facts, ["action_plan"])


def full_report(df: DataFrame, **limits) -> DataFrame:
    """All sections in order; ``limits`` are those of ``Facts``."""
    return _sections(gather_facts(df, **limits), SECTIONS)
