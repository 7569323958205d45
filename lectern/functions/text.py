"""Column helpers for record text fields (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def headline(title) -> Column:
    """PRJ-14: ``"Learn " + title`` (units, sections, cards)."""
    return F.concat(F.lit("Learn "), _c(title))


def topics_csv(arr) -> Column:
    """PRJ-9: topic list → comma string."""
    return F.array_join(_c(arr), ",")


def topics_array(s) -> Column:
    """PRJ-9: comma string → topic list (an empty string gives ``[""]``)."""
    return F.split(_c(s), ",")


def global_id(kind: str, id_col) -> Column:
    """PRJ-11: base64 of ``kind:id`` without line wrapping."""
    raw = F.concat(F.lit(kind + ":"), _c(id_col)).cast("binary")
    return F.regexp_replace(F.base64(raw), r"[\r\n]", "")


def intl(c, locale) -> Column:
    """PRJ-13: a localized string with one default entry."""
    return F.array(F.struct(_c(c).alias("content"), F.lit(True).alias("is_default"),
                            _c(locale).alias("locale")))


def first_n(s, n: int) -> Column:
    """PRJ-19: first n characters (not bytes)."""
    return F.substring(_c(s), 1, n)


# PRJ-20: the hint markup removed from choice text (dot matches newline, lazy).
CHOICE_HINT_RE = r"(?s)<choicehint.+?</choicehint>"


def strip_hints(md) -> Column:
    return F.regexp_replace(_c(md), CHOICE_HINT_RE, "")


# Problem response tag → stored question type.
QUESTION_TYPES = {
    "stringresponse": "WSCQ",
    "multiplechoiceresponse": "MCSA",
    "choiceresponse": "MCMA",
    "optionresponse": "",
    "numericalresponse": "",
}


def question_type(tag) -> Column:
    """PRJ-15: response tag → question type ('' for option/numerical, NULL if unknown)."""
    m = F.create_map(*[F.lit(x) for kv in QUESTION_TYPES.items() for x in kv])
    return m[_c(tag)]


def question_time(qtype) -> Column:
    """PRJ-16: estimated seconds: 300 for code (string) questions, 60 for choice types."""
    q = _c(qtype)
    return F.when(q == "WSCQ", F.lit(300)).when(q.isin("MCSA", "MCMA"), F.lit(60))


def url_query_escape(s) -> Column:
    """Query-string escaping with the unreserved set A-Z a-z 0-9 - _ . ~ (space → '+')."""
    enc = F.url_encode(_c(s))
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_path_segment_escape(s) -> Column:
    """Path-segment escaping: like query escaping, but space → %20 and ``$&+:=@`` kept."""
    e = url_query_escape(s)
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    for enc, ch in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@")):
        e = F.replace(e, F.lit(enc), F.lit(ch))
    return e
