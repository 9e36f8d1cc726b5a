"""Predicates over revisions. Each returns a boolean Column.

Matching is case sensitive and knows no word boundaries. Wherever the meaning
allows, a predicate is a plain comparison, ``startswith`` or ``contains``, so
that it reaches the Parquet reader and stays inside generated code.
"""

import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from editwake.functions import derive, grams
from editwake.schema import TEXT_FIELDS

DEFAULT_N = grams.DEFAULT_GRAM


def _column(field: str | Column) -> Column:
    return F.col(field) if isinstance(field, str) else field


def _is_text(field: str | Column) -> bool:
    return not isinstance(field, str) or field in TEXT_FIELDS


# --- load filters ---------------------------------------------------------


def pass_all() -> Column:
    return F.lit(True)


def talk_only(namespace: str | Column = "namespace") -> Column:
    """Odd namespaces; a negative one never passes, as its remainder is not 1."""
    return _column(namespace) % 2 == 1


def user_talk_only(namespace: str | Column = "namespace") -> Column:
    return _column(namespace) == 3


# --- single values ----------------------------------------------------------


def term(field: str | Column, value) -> Column:
    """The whole value; ``None`` asks for an absent one (user ids)."""
    return _column(field).isNull() if value is None else _column(field) == value


def phrase(field: str | Column, text: str | Column) -> Column:
    """Quoted text: the substring test."""
    return _column(field).contains(text)


def all_grams(field: str | Column, text: str, n: int = DEFAULT_N) -> Column:
    """Unquoted text: every n-gram of it occurs, anywhere and in any order.

    Words separated by spaces are separate pieces, as a query parser splits
    them. A word shorter than n has no gram and is tested whole.
    """
    parts = [g for word in text.split() for g in grams.literal_ngrams(word, n) or [word]]
    return all_of(*[phrase(field, g) for g in dict.fromkeys(parts)])


def any_gram(field: str | Column, text: str, n: int = DEFAULT_N) -> Column:
    """Unquoted text under the OR reading: at least one of its n-grams occurs."""
    parts = [g for word in text.split() for g in grams.literal_ngrams(word, n) or [word]]
    return any_of(*[phrase(field, g) for g in dict.fromkeys(parts)])


def near(field: str | Column, parts: list[str], slop: int) -> Column:
    """The parts in order, with at most ``slop`` characters between neighbours."""
    between = f".{{0,{slop}}}"
    return _column(field).rlike("(?s)" + between.join(re.escape(p) for p in parts))


def _fixed_length_patterns(pattern: str, n: int) -> list[str]:
    """Regular expressions for the n-character strings a wildcard matches."""
    pieces = re.split(r"\*+", pattern)
    slack = n - sum(len(p) for p in pieces)
    if slack < 0 or (len(pieces) == 1 and slack):
        return []

    def spread(left: int, gaps: int) -> list[list[int]]:
        if gaps == 1:
            return [[left]]
        return [[k, *rest] for k in range(left + 1) for rest in spread(left - k, gaps - 1)]

    literal = ["".join("." if c == "?" else re.escape(c) for c in p) for p in pieces]
    widths = spread(slack, len(pieces) - 1) if len(pieces) > 1 else [[]]
    return [
        "".join(p + (f".{{{w}}}" if w else "") for p, w in zip(literal, [*gaps, 0]))
        for gaps in widths
    ]


def text_wildcard(pattern: str, n: int = DEFAULT_N) -> str:
    """A wildcard against a gram of a text field as an expression over the text; one that
    finds nothing if no gram can match."""
    patterns = _fixed_length_patterns(pattern, n)
    return "(?s)" + "|".join(patterns) if patterns else "(?!)"


def wildcard(field: str | Column, pattern: str, n: int = DEFAULT_N) -> Column:
    """``?`` and ``*`` against a gram of a text field, or a whole keyword value.

    A gram has exactly n characters, so on text every ``*`` has finitely many
    widths and the test is one regular expression over the field.
    """
    if not _is_text(field):
        like = re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%").replace("?", "_")
        return _column(field).cast("string").like(like)
    patterns = _fixed_length_patterns(pattern, n)
    if not patterns:
        return F.lit(False)
    return _column(field).rlike("(?s)" + "|".join(patterns))


def prefix(field: str | Column, text: str, n: int = DEFAULT_N) -> Column:
    """``p*``: start of a keyword value, or of a gram of a text field."""
    if not _is_text(field):
        return _column(field).cast("string").startswith(text)
    return wildcard(field, text + "*", n)


def fuzzy(field: str | Column, text: str, distance: int, n: int = DEFAULT_N) -> Column:
    """Within an edit distance of a gram of a text field, or of a keyword value."""
    if not _is_text(field):
        return F.levenshtein(_column(field).cast("string"), F.lit(text), distance) >= 0
    if abs(len(text) - n) > distance:
        return F.lit(False)  # each edit changes the length by one at most
    return F.exists(
        grams.ngrams(_column(field), n), lambda g: F.levenshtein(g, F.lit(text), distance) >= 0
    )


def regexp(field: str | Column, pattern: str) -> Column:
    """A regular expression found in a text field, or that is a whole keyword value."""
    if not _is_text(field):
        return _column(field).cast("string").rlike(rf"\A(?:{pattern})\z")
    return _column(field).rlike(pattern)


# --- ranges -----------------------------------------------------------------

_BOUND_FORMATS = {
    4: "%Y",
    7: "%Y-%m",
    10: "%Y-%m-%d",
    13: "%Y-%m-%dT%H",
    16: "%Y-%m-%dT%H:%M",
    19: "%Y-%m-%dT%H:%M:%S",
    20: "%Y-%m-%dT%H:%M:%SZ",
}


def _instant(bound: str) -> datetime | None:
    """The first instant a (partial) time text stands for, if it is regular."""
    text = bound.rstrip("-T:")
    try:
        return datetime.strptime(text, _BOUND_FORMATS[len(text)]).replace(tzinfo=timezone.utc)
    except (KeyError, ValueError):
        return None


def ts_range(
    lo: str | None = None,
    hi: str | None = None,
    ts: str | Column = "timestamp",
    month: str | Column | None = None,
) -> Column:
    """Inclusive time range over ISO text bounds, whole or partial.

    Bounds compare as text: a partial upper bound sorts before every instant
    it is a prefix of, so ``2007-01`` ends the range before January 2007, and
    a whole bound is included. Irregular bounds (``0``, ``Z``, one-digit
    months) are compared as text literally. ``month`` names a partition column
    in ``yyyy-MM``; it gets an implied predicate so that partitions are pruned.
    """
    column = _column(ts)
    tests = []
    # The customary open ends, below and above every year.
    lo = None if lo == "0" else lo
    hi = None if hi == "Z" else hi
    if lo is not None:
        start = _instant(lo)
        tests.append(column >= F.lit(start) if start else derive.iso_timestamp(column) >= lo)
        if start and month is not None:
            tests.append(_column(month) >= start.strftime("%Y-%m"))
    if hi is not None:
        end = _instant(hi)
        if end is None:
            tests.append(derive.iso_timestamp(column) <= hi)
        else:
            tests.append(column <= F.lit(end) if hi.endswith("Z") else column < F.lit(end))
            if month is not None:
                tests.append(_column(month) <= end.strftime("%Y-%m"))
    return all_of(*tests)


def value_range(
    field: str | Column, lo=None, hi=None, incl_lo: bool = True, incl_hi: bool = True
) -> Column:
    """A range of any keyword field, in the order of its type; None is open."""
    column = _column(field)
    tests = []
    if lo is not None:
        tests.append(column >= lo if incl_lo else column > lo)
    if hi is not None:
        tests.append(column <= hi if incl_hi else column < hi)
    return all_of(*tests) if tests else column.isNotNull()


# What each part of a time text may look like.
_PARTIAL_DATETIME = (
    r"^[0-9]{4}(-((1[0-2]|0?[1-9])(-((3[01]|[12][0-9]|0?[1-9])"
    r"(T((2[0-3]|[01]?[0-9])(:(([0-5]?[0-9])(:((6[01]|[0-5]?[0-9])Z?)?)?)?)?)?)?)?)?)?)?$"
)


def names_real_time(bound: str) -> bool:
    """``is_partial_datetime`` of a bound that is known when planning."""
    if not re.match(_PARTIAL_DATETIME, bound):
        return False
    day = re.match(r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", bound)
    try:
        return day is None or bool(datetime(*map(int, day.groups())))
    except ValueError:
        return False


def is_partial_datetime(s: Column) -> Column:
    """Whether a text is an ISO time or a start of one, and names a real day.

    The whole form with its ``Z`` is accepted as well.
    """
    day = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1)
    return s.rlike(_PARTIAL_DATETIME) & (
        (day == "") | F.try_to_timestamp(day, F.lit("yyyy-M-d")).isNotNull()
    )


# --- combination ------------------------------------------------------------


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True)) if len(predicates) != 1 else predicates[0]


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False)) if len(predicates) != 1 else predicates[0]


def none_of(*predicates: Column) -> Column:
    """The complement; a missing value counts as not matching."""
    return ~F.coalesce(any_of(*predicates), F.lit(False))


def trend_predicate(
    query: str | Column,
    start: str | None = None,
    end: str | None = None,
    namespace: int | None = None,
    field: str = "added",
    month: str | Column | None = None,
) -> Column:
    """What a trend is drawn of: a phrase or a predicate, a time range, a namespace."""
    for bound in (start, end):
        if bound and bound not in ("0", "Z") and not names_real_time(bound):
            raise ValueError(f"neither a time nor the start of one: {bound}")
    tests = [phrase(field, query) if isinstance(query, str) else query]
    if start or end:
        tests.append(ts_range(start or "0", end or "Z", month=month))
    if namespace is not None:
        tests.append(term("namespace", namespace))
    return all_of(*tests)
