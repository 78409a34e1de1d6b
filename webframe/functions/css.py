"""Links of style sheets, found and replaced with one regular expression.

The expression walks the text token by token (comment, string, word, URL), so
``url(...)`` inside comments, strings or longer names is never taken for a
link. All repeats are possessive: matching is linear and needs no deep stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions.common import ALL, as_col, let, memo, record

_WS = r"[ \t\n\f\r]"
_ESC = r"\\(?:[0-9A-Fa-f]{1,6}+[ \t\n\f\r]?+|[^\n\f\r0-9A-Fa-f])"
_STR_ESC = rf"(?:{_ESC}|\\(?:\r\n|[\n\f\r]|\z))"
_DQ = rf'"(?:[^"\\\n\f\r]++|{_STR_ESC})*+'
_SQ = rf"'(?:[^'\\\n\f\r]++|{_STR_ESC})*+"
_STRING = rf'(?:{_DQ}(?:"|\z)|{_SQ}(?:\'|\z))'
_ANY_STRING = rf'(?:{_DQ}(?:["\n\f\r]|\z)|{_SQ}(?:[\'\n\f\r]|\z))'
_UNQUOTED = rf"(?:[^\"'()\\\x00-\x20\x7F]++|{_ESC})*+"
_GOOD_URL = rf"(?i:url)\({_WS}*+(?:{_STRING}|(?![\"']){_UNQUOTED}){_WS}*+(?:\)|\z)"
_BAD_URL = rf"(?i:url)\({_WS}*+{_ANY_STRING}?+(?:[^)\\]++|\\(?:.|\z))*+(?:\)|\z)"
_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
_WORD = rf"(?!(?i:url)\()[@#]?+(?:[-\w]|[^\x00-\x7F]|{_ESC})++"
_OTHER = r"[^-\w\"'\\/@#\u0080-\x{10FFFF}]++|/(?!\*)|[@#\\]"
_SKIP = rf"(?:{_COMMENT}|{_ANY_STRING}|{_WORD}|{_OTHER})++"

_TOKENS = rf"(?s){_SKIP}|({_GOOD_URL})|{_BAD_URL}"
#: The two usual forms of a token.
_BARE = r"\Aurl\([^'\"`() \t\n\f\r]*+\)\z"
_QUOTED = r"\Aurl\((?:'[^'\"`()]*+'|\"[^'\"`()]*+\")\)\z"
_BLANKS, _QUOTES = " \t\n\f\r", ("'", '"', "`")


def _address(tail: Column) -> Column:
    """``STRUCT<start, url>`` of what follows a ``url``: characters before the address, and the address; NULL if there is none.

    After the bracket and at most one quote the address runs to the next quote, which the closing bracket must
    follow; failing that, to the last closing bracket before that quote.
    """

    def inside(x):
        body, run = x["body"], x["run"]
        rest = F.substring(body, F.length(run) + 1, ALL)
        unquoted = F.when(F.left(rest, F.lit(1)).isin(*_QUOTES), F.substring(rest, 2, ALL)).otherwise(rest)
        closed = F.ltrim(unquoted, F.lit(_BLANKS)).startswith(")")
        short = F.substring(run, F.lit(1), F.length(run) - F.length(F.substring_index(run, ")", -1)) - 1)
        url = F.when(closed, run).when(run.contains(")"), short)
        return F.when(x["opened"] & url.isNotNull(), record(start=x["before"], url=url))

    def run(x):
        ends = [F.coalesce(F.nullif(F.locate(q, x["body"]), F.lit(0)), F.length(x["body"]) + 1) for q in _QUOTES]
        return let({"body": x["body"], "run": F.substring(x["body"], F.lit(1), F.least(*ends) - 1), "opened": x["opened"], "before": x["before"]}, inside)

    def body(x):
        first = F.ltrim(F.substring(x["bracket"], 2, ALL), F.lit(_BLANKS))
        body = F.when(F.left(first, F.lit(1)).isin(*_QUOTES), F.substring(first, 2, ALL)).otherwise(first)
        parts = {"body": body, "opened": x["bracket"].startswith("("), "all": x["all"]}
        return let(parts, lambda y: let({"body": y["body"], "opened": y["opened"], "before": y["all"] - F.length(y["body"])}, run))

    return let({"bracket": F.ltrim(tail, F.lit(_BLANKS)), "all": F.length(tail)}, body)


def _inner(token: Column) -> Column:
    """``STRUCT<start, url>`` of the address a token links to: behind the first ``url`` that has one, which may lie in a string.

    Most tokens hold an address and at most a pair of quotes; what these link to follows from their length.
    """
    size = F.length(token)
    bare = record(start=F.lit(4), url=F.substring(token, F.lit(5), size - 5))
    quoted = record(start=F.lit(5), url=F.substring(token, F.lit(6), size - 7))
    places = F.size(F.split(token, "url")) - 1

    def behind(k):
        tail = F.element_at(F.split(token, "url", k), -1)
        found = let(tail, lambda t: let(_address(t), lambda a: record(start=F.length(token) - F.length(t) + a["start"], url=a["url"])))
        return found

    found = F.transform(F.sequence(F.lit(2), places + 1), behind)
    any_ = F.when(places > 0, F.get(F.filter(found, lambda a: a["url"].isNotNull()), F.lit(0)))
    return F.when(token.rlike(_BARE), bare).when(token.rlike(_QUOTED), quoted).otherwise(any_)


def css_url_tokens(css: Column | str) -> Column:
    """``ARRAY<STRING>`` of the well-formed ``url(...)`` tokens."""
    tokens = F.regexp_extract_all(as_col(css), F.lit(_TOKENS), F.lit(1))
    return F.filter(tokens, lambda t: t != "")


@memo
def css_urls(css: Column | str) -> Column:
    """``ARRAY<STRING>`` of linked URLs in order, duplicates and ``''`` kept."""

    def scan(css):
        linked = F.transform(css_url_tokens(css), lambda t: _inner(t)["url"])
        urls = F.filter(linked, lambda u: u.isNotNull())
        # Few texts hold a URL at all; a substring test spares the others the scan.
        none = F.array().cast("array<string>")
        return F.when(F.lower(css).contains("url("), urls).otherwise(none)

    return let(as_col(css), scan)


def rewrite_css(css: Column | str, replace: Callable[[Column], Column]) -> Column:
    """The text with every linked URL put through ``replace``."""

    def put(t, found):
        end = found["start"] + F.length(found["url"]) + 1
        spliced = F.concat(F.substring(t, F.lit(1), found["start"]), replace(found["url"]), F.substring(t, end, F.lit(ALL)))
        return F.coalesce(spliced, t)

    def one(t):
        linked = F.when(t.rlike(rf"\A(?s:{_GOOD_URL})\z"), _inner(t))
        return let(linked, lambda found: put(t, found))

    def splice(css):
        tokens = F.regexp_extract_all(css, F.lit(_TOKENS), F.lit(0))
        joined = F.array_join(F.transform(tokens, one), "")
        return F.when(F.lower(css).contains("url("), joined).otherwise(css)

    return let(as_col(css), splice)
