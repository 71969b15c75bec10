"""Expressions that read numbers and dates out of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols stripped from numbers, all kinds of white space, date layouts in order of preference.
CURRENCY_AND_GROUPING = "$₹€£¥,"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Two-digit years from here on belong to the last century.
PIVOT_YEAR = 69
#: No date is longer.
MOST_DATE_CHARACTERS = 64
DATE_NAME_HINT = r"(?i)date|time|dt|timestamp|year|month|day"

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))$"


def parse_number(text: Column) -> Column:
    """Double read from text with currency signs, thousands separators or a percent sign.

    Percentages keep their face value.  Spark's cast alone would also take
    ``1d`` or ``0x1p3``, hence the guard; it also turns down every placeholder
    for a missing value.
    """
    bare = F.translate(text, CURRENCY_AND_GROUPING + WHITE_SPACE, "")
    bare = F.when(bare.endswith("%"), F.left(bare, F.length(bare) - 1)).otherwise(bare)
    return F.when(bare.rlike(_NUMBER), bare).try_cast("double")


_FIELD_SHAPES = {
    "yyyy": r"\d{4}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "SSSSSS": r"\d{6}", "SSSSSSSSS": r"\d{1,9}",
    "XXX": r"(Z|[+-]\d{2}:\d{2})", "yy": r"\d{2}", "MM": r"\d{2}", "dd": r"\d{2}", "h": r"\d{1,2}", "a": r"[AaPp][Mm]",
    "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}",
}


def layout_shape(layout: str) -> str:
    """Regular expression of the texts that a date layout can read."""
    fields = re.compile("'(.)'|" + "|".join(sorted(_FIELD_SHAPES, key=len, reverse=True)))
    shape, end = "", 0
    for found in fields.finditer(layout):
        shape += re.escape(layout[end : found.start()]) + (found.group(1) or _FIELD_SHAPES[found.group()])
        end = found.end()
    return f"^{shape}{re.escape(layout[end:])}$"


_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?"
)
_WEEKDAY = r"(?:(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?\s*,?\s+)?"
_NTH = "(?:st|nd|rd|th)?"
# the alternatives of a date, then a time, then an offset; names are fields, a digit behind a name tells alternatives apart
_DATES = [
    r"(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{1,2})(?P=s1)(?P<d1>\d{1,2})",
    r"(?P<y2>\d{4})[-/](?P<m2>\d{2})",
    r"(?P<y3>\d{4})-?w(?P<w3>\d{2})(?:-?(?P<e3>[1-7]))?",
    r"(?P<a4>\d{1,2})(?P<s4>[-/.])(?P<b4>\d{1,2})(?P=s4)(?P<y4>\d{4}|\d{2})",
    r"(?P<y5>\d{4})(?P<m5>\d{2})(?P<d5>\d{2})",
    rf"(?P<d6>\d{{1,2}}){_NTH}[-.\s]\s*(?:of\s+)?(?P<n6>{_MONTH})(?:\.?\s*,\s*|\.?\s+|-)(?P<y6>\d{{4}}|\d{{2}})",
    rf"(?P<n7>{_MONTH})(?:\.?\s+|-)(?P<d7>\d{{1,2}}){_NTH}(?:\s*,\s*|\s+|-)(?P<y7>\d{{4}})",
    rf"(?P<n8>{_MONTH})(?:\.?\s*,\s*|\.?\s+|-)(?P<y8>\d{{4}})",
    rf"(?P<y9>\d{{4}})[-\s](?P<n9>{_MONTH})[-\s](?P<d9>\d{{1,2}})",
]
_TIMES = [
    r"(?P<H1>\d{1,2}):(?P<M1>\d{1,2})(?::(?P<S1>\d{1,2})(?:[.,](?P<f1>\d{1,9}))?)?(?:\s*(?P<p1>[ap])\.?m\.?)?",
    r"(?P<H2>\d{1,2})\s*(?P<p2>[ap])\.?m\.?",
    r"(?<=t)(?P<H3>\d{2})(?P<M3>\d{2})(?:(?P<S3>\d{2})(?:[.,](?P<f3>\d{1,9}))?)?",
]
_GRAMMAR = (
    rf"(?i)^{_WEEKDAY}(?:{'|'.join(_DATES)})(?:(?:\s*t\s*|\s*,\s*|\s+)(?:at\s+)?(?:{'|'.join(_TIMES)}))?"
    r"(?:\s*(?P<z>z|utc|gmt)|\s*(?:utc|gmt)?(?P<g>[+-])(?P<zh>\d{2}):?(?P<zm>\d{2})?)?$"
)
# how every date begins; it turns most other texts down at their first letters
_BEGINNING = rf"(?i)^\s*{_WEEKDAY}(?:\d{{1,2}}(?:[-/.\s]\s*(?:of\s+)?(?:\d|{'|'.join(MONTHS)})|{_NTH[:-1]})|\d{{4}}(?:[-/.\s]|-?w\d|\d{{4}}(?!\d))|(?:{_MONTH})[-.,\s])"
_GROUPS = re.findall(r"\(\?P<(\w+)>", _GRAMMAR)
_MARK = "\x01"
#: What is read of a date, and the groups that may hold it: a date fits one alternative, so the others are empty.
_FIELDS = {
    "year": [g for g in _GROUPS if g[0] == "y"], "month": ["m1", "m2", "m5"], "day": ["d1", "d5", "d6", "d7", "d9"],
    "name": [g for g in _GROUPS if g[0] == "n"], "first": ["a4"], "dot": ["s4"], "second": ["b4"], "week": ["w3"],
    "weekday": ["e3"], "hour": ["H1", "H2", "H3"], "minute": ["M1", "M3"], "seconds": ["S1", "S3"],
    "fraction": ["f1", "f3"], "half": ["p1", "p2"], "utc": ["z"], "sign": ["g"], "ahead": ["zh"], "minutes": ["zm"],
}
_AT = {name: k for k, name in enumerate(_FIELDS)}


def _engine_pattern() -> str:
    """The grammar with numbered groups."""
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{_GROUPS.index(m.group(1)) + 1}(?:)", _GRAMMAR)
    return re.sub(r"\(\?P<\w+>", "(", plain)


def _engine_replacement() -> str:
    """The fields behind one another."""
    return _MARK.join("".join(f"${_GROUPS.index(g) + 1}" for g in groups) for groups in _FIELDS.values())


def _bound(value: Column, make) -> Column:
    """``make`` of a value that is computed once."""
    return F.transform(F.array(value), make)[0]


def _read_fields(p: Column, day_first: bool) -> Column:
    """Timestamp of the grammar's fields."""

    def text(name: str) -> Column:
        return p[_AT[name]]

    def number(name: str) -> Column:
        # a failed cast costs an exception
        return F.when(text(name) != "", text(name).try_cast("int"))

    def month_and_day(pair: Column) -> Column:
        # the day stands first behind dots, if asked for, or where the first number is no month
        first, second = pair["first"], pair["second"]
        swapped = (first > 12) | ((F.lit(day_first) | (text("dot") == ".")) & (second <= 12))
        return F.struct(F.when(swapped, second).otherwise(first).alias("month"), F.when(swapped, first).otherwise(second).alias("day"))

    name = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(text("name"), F.lit(3)))).cast("int")
    month = F.when(text("month") != "", number("month")).when(text("name") != "", name).otherwise(1)
    plain = F.struct(month.alias("month"), F.when(text("day") != "", number("day")).otherwise(1).alias("day"))
    pair = _bound(F.struct(number("first").alias("first"), number("second").alias("second")), month_and_day)
    date = F.when(text("first") == "", plain).otherwise(pair)
    # a two-digit year of this or the last century
    year = F.when(F.length(text("year")) > 2, number("year")).otherwise(
        number("year") + F.when(text("year") < str(PIVOT_YEAR), 2000).otherwise(1900)
    )
    half = F.lower(text("half"))
    clock = F.when(half == "", number("hour")).when(
        number("hour").between(1, 12), number("hour") % 12 + F.when(half == "p", 12).otherwise(0)
    )
    clock = F.when(text("hour") == "", 0).otherwise(clock)
    seconds = F.concat(F.when(text("seconds") == "", "0").otherwise(text("seconds")), F.lit("."), F.left(F.rpad(text("fraction"), 6, "0"), F.lit(6)))
    parts = F.struct(
        year.alias("y"), date.alias("date"), clock.alias("h"), F.when(text("minute") == "", 0).otherwise(number("minute")).alias("mi"),
        seconds.cast("decimal(16,6)").alias("s"),
    )

    def moment(v: Column) -> Column:
        # the fourth of January lies in the first week
        fourth = F.try_make_timestamp_ntz(v["y"], F.lit(1), F.lit(4), v["h"], v["mi"], v["s"])
        days = F.when(text("weekday") == "", 0).otherwise(number("weekday") - 1) - F.weekday(fourth) + 7 * (number("week") - 1)
        of_week = _bound(fourth + F.make_dt_interval(days), lambda d: F.when(F.weekofyear(d) == number("week"), d))
        read = F.try_make_timestamp_ntz(v["y"], v["date"]["month"], v["date"]["day"], v["h"], v["mi"], v["s"])
        return F.when(text("week") == "", read).otherwise(of_week)

    def on_session_clock(read: Column) -> Column:
        ahead = F.when(text("sign") == "-", -1).otherwise(1) * (60 * number("ahead") + F.coalesce(number("minutes"), F.lit(0)))
        utc = read - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(ahead, F.lit(0)))
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), utc)

    local = _bound(parts, moment)
    return F.when((text("utc") == "") & (text("sign") == ""), local).otherwise(_bound(local, on_session_clock))


def _fields(text: Column) -> Column:
    """The grammar's fields in the text, empty where absent; NULL for a text that is no date."""
    value = F.trim(text)
    found = F.split(F.regexp_replace(value, _engine_pattern(), _engine_replacement()), _MARK)
    return F.when(_may_be_date(text) & ~value.contains(_MARK), found)


def _may_be_date(text: Column) -> Column:
    return (F.length(text) <= 2 * MOST_DATE_CHARACTERS) & text.rlike(_BEGINNING) & (F.length(F.trim(text)) <= MOST_DATE_CHARACTERS)


def day_order_votes(text: Column) -> tuple[Column, Column]:
    """Whether only the first, and only the second, of two numbers before a year can be the day."""

    def votes(p: Column) -> Column:
        a, b = (p[_AT[n]].try_cast("int") for n in ("first", "second"))
        return F.when((a > 12) & (b <= 12), 1).when((a <= 12) & (b > 12), 2)

    vote = _bound(_fields(text), lambda p: F.when(F.size(p) == len(_FIELDS), votes(p)))
    vote = F.when(_may_be_date(text), vote)
    return vote == 1, vote == 2


def parse_timestamp(text: Column, layouts: list[str] | None = None, day_first: bool = False) -> Column:
    """Timestamp (without zone) of a date in text, with or without a time and an offset.

    Reads years first, numbers with the month first (``day_first``: the day), names of months in English, ISO weeks,
    compact forms, 12- and 24-hour times, fractions of seconds. Numbers that cannot be a month are days. A text with an
    offset gives the time on the session's clock. Two-digit years from ``PIVOT_YEAR`` on are of the last century. Dates in
    frequent shapes are cast, one regular expression takes all others apart; ``layouts`` reads patterns of ``to_timestamp`` instead, the first that fits.
    """
    if layouts is not None:
        return _by_layout(F.trim(text), layouts)
    return _by_frequent_shape(text, day_first, _by_grammar(text, day_first))


def _by_grammar(text: Column, day_first: bool) -> Column:
    # bound values are interpreted, so texts that are no dates are kept away from them
    read = _bound(_fields(text), lambda p: F.when(F.size(p) == len(_FIELDS), _read_fields(p, day_first)))
    return F.when(_may_be_date(text), read)


# shapes of frequent dates; a shape takes only texts that a cast of its parts reads as the grammar does
_SECOND = r":[0-5]?\d(?:\.\d{1,6})?"
_TIME = rf"\d{{1,2}}:\d{{1,2}}(?:{_SECOND})?"
_HALF_TIME = rf"(?:0?[1-9]|1[0-2]):\d{{1,2}}(?:{_SECOND})?"
#: Groups of a time, and of a time before AM or PM, behind a date.
_CLOCK = rf"(?: (?:({_TIME})|({_HALF_TIME}) (?i:[ap]m)))?"
_MONTH_NUMBER = "(0?[1-9]|1[0-2])"
_ISO = rf"^\d{{4}}(?:[-/]\d{{2}}|([-/])\d{{1,2}}\1\d{{1,2}}(?:[ T]{_TIME})?)$"
_ISO_ZONE = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}[ T]\d{{1,2}}:\d{{1,2}}{_SECOND}(?:Z| UTC|[+-](?:0\d|1[0-7]):?[0-5]\d)$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_COMPACT_TIME = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})([0-5]\d)$"
_WEEK = r"^\d{4}-W\d{2}$"
_LETTERS = rf"(?i:{_MONTH})"
_DAY_NAME = rf"^(\d{{1,2}})(?i:{_NTH})[- ]{_LETTERS}[- ](\d{{4}}){_CLOCK}"
_WEEKDAY_NAME = rf"^(?i:mon|tue|wed|thu|fri|sat|sun), (\d{{1,2}}) {_LETTERS} (\d{{4}}){_CLOCK}"
_NAME_DAY = rf"^{_LETTERS}[- ](\d{{1,2}}),? (\d{{4}}){_CLOCK}"
_NAME_YEAR = rf"^{_LETTERS}[- ](\d{{4}})"


def _by_frequent_shape(text: Column, day_first: bool, rest: Column) -> Column:
    """Timestamps of dates in frequent shapes by casts, which are compiled; ``rest`` reads all other texts."""
    half = F.lower(F.right(text, F.lit(2)))
    noon = text.contains(" 12:")
    hours = F.when((half == "pm") & ~noon, 12).when((half == "am") & noon & text.contains(":"), -12).otherwise(0)

    def put(shape: str, order: str, of: Column = text, has_clock: bool = True) -> Column:
        """The shape's groups in the order of a timestamp."""
        read = F.regexp_replace(of, shape, order).try_cast("timestamp_ntz")
        return read + F.make_dt_interval(F.lit(0), hours) if has_clock else read

    def named(shape: str, order: str, start: Column, has_clock: bool = True) -> Column:
        """A date whose month's name begins at ``start``; the month's number is put behind the text as its last group."""
        place = F.instr(F.lit("".join(MONTHS)), F.lower(F.substr(text, start, F.lit(3))))
        return put(rf"{shape}\|(\d+)$", order, F.concat(text, F.lit("|"), F.floor((place + 2) / 3).cast("string")), has_clock)

    cases: list[tuple[str, Column]] = [(_ISO, F.translate(text, "/", "-").try_cast("timestamp_ntz"))]
    # numbers before the year; two digits from PIVOT_YEAR on are of the last century
    years = [(r"(\d{4})", ""), (r"([0-5]\d|6[0-8])", "20"), (r"(69|[7-9]\d)", "19")]
    dots = "[-/.]" if day_first else r"\."
    for year, century in years:
        if not day_first:
            shape = rf"^{_MONTH_NUMBER}([-/])(\d{{1,2}})\2{year}{_CLOCK}$"
            cases.append((shape, put(shape, f"{century}$4-$1-$3 $5$6")))
        shape = rf"^(?=\d{{1,2}}{dots}|(?:1[3-9]|[2-9]\d)[-/])(\d{{1,2}})([-/.]){_MONTH_NUMBER}\2{year}{_CLOCK}$"
        cases.append((shape, put(shape, f"{century}$4-$3-$1 $5$6")))
    cases.append((_COMPACT, put(_COMPACT, "$1-$2-$3", has_clock=False)))
    cases.append((_COMPACT_TIME, put(_COMPACT_TIME, "$1-$2-$3 $4:$5:$6", has_clock=False)))
    cases.append((_ISO_ZONE, text.try_cast("timestamp").cast("timestamp_ntz")))
    # the fourth of January lies in the first week
    fourth = F.concat(F.left(text, F.lit(4)), F.lit("-01-04")).try_cast("date")
    week = F.substring(text, 7, 2).try_cast("int")
    monday = F.date_add(fourth, 7 * (week - 1) - F.weekday(fourth))
    cases.append((_WEEK, F.when(F.weekofyear(monday) == week, monday).cast("timestamp_ntz")))
    # names of months
    first = F.substring_index(F.substring_index(text, " ", 1), "-", 1)
    cases.append((f"{_DAY_NAME}$", named(_DAY_NAME, "$2-$5-$1 $3$4", F.length(first) + 2)))
    second = F.when(F.substring(text, 7, 1) == " ", 8).otherwise(9)
    letters = [
        (f"{_NAME_DAY}$", named(_NAME_DAY, "$2-$5-$1 $3$4", F.lit(1))),
        (f"{_NAME_YEAR}$", named(_NAME_YEAR, "$1-$2", F.lit(1), has_clock=False)),
        (f"{_WEEKDAY_NAME}$", named(_WEEKDAY_NAME, "$2-$5-$1 $3$4", second)),
    ]
    digit = F.left(text, F.lit(1)).between("0", "9")
    shapes = [digit & text.rlike(s) for s, _ in cases] + [~digit & text.rlike(s) for s, _ in letters]
    found = F.when(shapes[0], cases[0][1])
    for shape, (_, read) in zip(shapes[1:], cases[1:] + letters, strict=True):
        found = found.when(shape, read)
    return found.otherwise(rest)


def _by_layout(value: Column, layouts: list[str]) -> Column:
    # a failed parse costs the JVM an exception, so a layout is only tried on texts of its shape
    by_shape: dict[str, list[Column]] = {}
    for layout in layouts:
        by_shape.setdefault(layout_shape(layout), []).append(F.try_to_timestamp(value, F.lit(layout)))
    shapes = iter(by_shape.items())
    shape, tries = next(shapes)
    parsed = F.when(value.rlike(shape), F.coalesce(*tries))
    for shape, tries in shapes:
        parsed = parsed.when(value.rlike(shape), F.coalesce(*tries))
    return parsed.cast("timestamp_ntz")
