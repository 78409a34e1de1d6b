"""Links of HTML documents, found and replaced inside JVM expressions.

A document is cut into pieces by one regular expression that follows the HTML
tokenizer: comments, markup declarations, end tags and the text of script-like
elements are stepped over, and each start tag that can hold a link comes out as
a piece. The pieces joined give the document back, so replacing links leaves
every other byte alone. All repeats are possessive: matching is linear and
needs no deep stack.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions.common import as_col, let, memo, record
from webframe.functions.css import css_urls, rewrite_css

_W = r"[ \t\n\f\r]"
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|(?=>)|(?![\"'])[^ \t\n\f\r>]++)"
_ATTR = rf"{_NAME}(?:{_W}*+={_W}*+{_VALUE}|(?!{_W}*+=))"
_ATTRS = rf"(?:[ \t\n\f\r/]++|{_ATTR})*+"
_TAG_END = r"(?=[ \t\n\f\r/>])"
_STYLE_ATTR = r"style(?=[ \t\n\f\r/>=])"
_NO_STYLE_ATTRS = rf"(?:[ \t\n\f\r/]++|(?!{_STYLE_ATTR}){_ATTR})*+"

# Elements with links, and elements whose content is only text.
_LINKING = "a|link|img|image|style"
_TEXT_ONLY = "script|title|textarea|iframe|noembed|noframes|noscript|xmp"

_COMMENT = r"<!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>|\z))"
_BOGUS = r"<(?:[!?]|/(?![A-Za-z]))[^>]*+>?+"
_END_TAG = rf"</[A-Za-z][^ \t\n\f\r/>]*+{_ATTRS}>"
_RAW_SKIP = rf"<({_TEXT_ONLY}){_TAG_END}{_NO_STYLE_ATTRS}>(?:[^<]++|<(?!/\1{_TAG_END}))*+"
_PLAINTEXT = rf"<plaintext{_TAG_END}.*+"
_PLAIN_TAG = (
    rf"<(?!(?:{_LINKING}|{_TEXT_ONLY}|plaintext){_TAG_END})[A-Za-z][^ \t\n\f\r/>]*+"
    rf"{_NO_STYLE_ATTRS}>"
)
_SKIP = (
    rf"(?:[^<]++|{_COMMENT}|{_BOGUS}|{_END_TAG}|{_RAW_SKIP}|{_PLAINTEXT}|{_PLAIN_TAG}"
    r"|<(?![A-Za-z/!?]))++"
)
_ELEMENT = (
    rf"(<(?:(style|{_TEXT_ONLY}){_TAG_END}{_ATTRS}>(?:[^<]++|<(?!/\3{_TAG_END}))*+"
    rf"|[A-Za-z][^ \t\n\f\r/>]*+{_ATTRS}>))"
)
_PIECES = rf"(?is){_SKIP}|{_ELEMENT}|<.*+"
_ELEMENT_GROUP = 2

_START_TAG = rf"(?is)\A<[A-Za-z][^ \t\n\f\r/>]*+{_ATTRS}>"
_STYLE_ATTRS = (
    rf"(?is)(?:\A<[^ \t\n\f\r/>]++|[ \t\n\f\r/]++|>|(?!{_STYLE_ATTR}){_ATTR})++|({_ATTR})"
)
# The attribute text, its value with quotes, and the value alone.
_ASSIGN = rf"(?is)\A([^ \t\n\f\r/>=]++(?:{_W}*+={_W}*+)?+)([\"']?)(.*)\2\z"


def _link_attr(name: str) -> str:
    """The tag up to the first attribute ``name``, and that attribute."""
    here = rf"{name}(?=[ \t\n\f\r/>=])"
    return (
        rf"(?is)\A(<[^ \t\n\f\r/>]++(?:[ \t\n\f\r/]++|(?!{here}){_ATTR})*+)(?={here})({_ATTR})"
    )


_HREF = _link_attr("href")
_SRC = _link_attr("src")
_NAMED_ENTITIES = "\u0002".join(f"{k}\u0003{v}" for k, v in html5.items())
# What the numbers 128 to 159 stand for in character references.
_C1 = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def _code_point(n: Column) -> Column:
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    c1 = F.substring(F.lit(_C1), n.cast("int") - 127, F.lit(1))
    c1 = F.when(c1 == "�", text).otherwise(c1)
    return F.when(bad | n.isNull(), "�").when(n.between(0x80, 0x9F), c1).otherwise(text)


def _decode_token(t: Column) -> Column:
    def number(x):
        digits = F.when(x["hex"], F.regexp_extract(t, r"\A&#[xX]0*([0-9A-Fa-f]*)", 1)).otherwise(
            F.regexp_extract(t, r"\A&#0*([0-9]*)", 1)
        )
        base = F.when(x["hex"], 16).otherwise(10)
        # Nine digits are beyond the last code point in either base.
        return let(
            digits,
            lambda d: F.when(F.length(d) > 9, "\ufffd").otherwise(
                let(
                    F.coalesce(F.call_function("conv", d, base, F.lit(10)).try_cast("bigint"), F.lit(0)),
                    _code_point,
                )
            ),
        )

    table = F.str_to_map(F.lit(_NAMED_ENTITIES), F.lit("\u0002"), F.lit("\u0003"))
    return (
        F.when(t == "&amp;", "&")
        .when(
            t.rlike(r"\A&#[xX]?[0-9A-Fa-f]"), let({"hex": t.rlike(r"\A&#[xX]")}, number)
        )
        .when(t.startswith("&"), F.coalesce(F.try_element_at(table, F.substring(t, 2, 64)), t))
        .otherwise(t)
    )


def decode_attribute(value: Column) -> Column:
    """Character references of an attribute value resolved."""
    pattern = (
        r"[^&]++|&#[xX][0-9A-Fa-f]++;?+|&#[0-9]++;?+"
        r"|&[A-Za-z0-9]++(?:;|(?![=A-Za-z0-9]))|&"
    )

    def decode(value):
        tokens = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
        decoded = F.array_join(F.transform(tokens, _decode_token), "")
        return F.when(value.contains("&"), decoded).otherwise(value)

    return let(value, decode)


def _encode_attribute(value: Column, quote: Column) -> Column:
    text = F.replace(value, F.lit("&"), F.lit("&amp;"))
    return F.when(quote == "'", F.replace(text, F.lit("'"), F.lit("&#39;"))).otherwise(
        F.replace(text, F.lit('"'), F.lit("&#34;"))
    )


def elements(html: Column | str) -> Column:
    """``ARRAY<STRING>`` of start tags that may hold links, in document order.

    Style elements come with their text.
    """
    pieces = F.regexp_extract_all(as_col(html), F.lit(_PIECES), F.lit(_ELEMENT_GROUP))
    return F.filter(pieces, lambda p: p != "")


def _tag_name(piece: Column) -> Column:
    name = F.lower(F.regexp_extract(piece, r"\A<([^ \t\n\f\r/>]+)", 1))
    return let(name, lambda n: F.when(n == "image", "img").otherwise(n))


def _attr_text(piece: Column, tag: Column) -> Column:
    """``name="value"`` of the linking attribute, ``''`` if there is none."""
    return (
        F.when(tag.isin("a", "link"), F.regexp_extract(piece, _HREF, 2))
        .when(tag == "img", F.regexp_extract(piece, _SRC, 2))
        .otherwise("")
    )


def _attr_value(attr: Column) -> Column:
    return decode_attribute(F.regexp_extract(attr, _ASSIGN, 3))


def _style_attrs(piece: Column) -> Column:
    tag = F.regexp_extract(piece, _START_TAG, 0)
    attrs = F.filter(
        F.regexp_extract_all(tag, F.lit(_STYLE_ATTRS), F.lit(1)), lambda a: a != ""
    )
    return F.when(piece.rlike(r"(?i)style"), attrs).otherwise(F.array().cast("array<string>"))


def _style_text(piece: Column, tag: Column) -> Column:
    return F.when(tag == "style", F.regexp_replace(piece, _START_TAG, "")).otherwise("")


def _link(kind: str, tag: Column, url: Column) -> Column:
    return record(kind=F.lit(kind), tag=tag, url=url)


@memo
def html_links(html: Column | str) -> Column:
    """``ARRAY<STRUCT<kind, tag, url>>`` of all links, in document order.

    ``kind`` is ``attr`` for ``a[href]``, ``link[href]`` and ``img[src]``,
    ``style_element`` and ``style_attr`` for ``url(...)`` in CSS.
    """

    def of_element(piece):
        def build(x):
            piece, tag, attr = x["piece"], x["tag"], x["attr"]
            none = F.array().cast("array<struct<kind:string,tag:string,url:string>>")
            own = F.when(attr != "", F.array(_link("attr", tag, _attr_value(attr)))).otherwise(none)
            text = F.transform(
                css_urls(_style_text(piece, tag)), lambda u: _link("style_element", tag, u)
            )
            inline = F.flatten(
                F.transform(
                    _style_attrs(piece),
                    lambda a: F.transform(
                        css_urls(_attr_value(a)), lambda u: _link("style_attr", tag, u)
                    ),
                )
            )
            return F.concat(own, text, inline)

        return let(
            _tag_name(piece),
            lambda tag: let({"piece": piece, "tag": tag, "attr": _attr_text(piece, tag)}, build),
        )

    return F.flatten(F.transform(elements(html), of_element))


def rewrite_html(html: Column | str, replace: Callable[[Column, Column], Column]) -> Column:
    """The document with every link put through ``replace(url, is_a)``.

    Attribute values that do not change keep their bytes.
    """

    def reassign(attr, value, new):
        def build(x):
            lead, mark = x["lead"], x["mark"]
            equals = F.when(lead.contains("="), "").otherwise("=")
            return F.concat(lead, equals, mark, _encode_attribute(x["new"], mark), mark)

        def choose(new):
            quote = F.regexp_extract(attr, _ASSIGN, 2)
            parts = {
                "lead": F.regexp_extract(attr, _ASSIGN, 1),
                "mark": F.coalesce(F.nullif(quote, F.lit("")), F.lit('"')),
                "new": new,
            }
            return F.when(value == new, attr).otherwise(let(parts, build))

        return let(new, choose)

    def link_attr(piece, tag):
        def splice(attr):
            start = F.when(tag == "img", F.regexp_extract(piece, _SRC, 1)).otherwise(
                F.regexp_extract(piece, _HREF, 1)
            )
            new = let(_attr_value(attr), lambda v: reassign(attr, v, replace(v, tag == "a")))

            def join(start):
                rest = F.substring(piece, F.length(start) + F.length(attr) + 1, F.length(piece))
                return F.concat(start, new, rest)

            return F.when(attr == "", piece).otherwise(let(start, join))

        return let(_attr_text(piece, tag), splice)

    def style_attrs(piece):
        def one(part):
            new = let(
                _attr_value(part),
                lambda v: reassign(part, v, rewrite_css(v, lambda u: replace(u, F.lit(False)))),
            )
            return F.when(part.rlike(rf"(?i)\A{_STYLE_ATTR}"), new).otherwise(part)

        def splice(start):
            parts = F.regexp_extract_all(start, F.lit(_STYLE_ATTRS), F.lit(0))
            rest = F.substring(piece, F.length(start) + 1, F.length(piece))
            joined = F.concat(F.array_join(F.transform(parts, one), ""), rest)
            return F.when(start.rlike(r"(?i)style[ \t\n\f\r]*="), joined).otherwise(piece)

        return let(F.regexp_extract(piece, _START_TAG, 0), splice)

    def style_text(piece, tag):
        def splice(start):
            text = F.substring(piece, F.length(start) + 1, F.length(piece))
            return F.concat(start, rewrite_css(text, lambda u: replace(u, F.lit(False))))

        return F.when(
            tag == "style", let(F.regexp_extract(piece, _START_TAG, 0), splice)
        ).otherwise(piece)

    def of_piece(piece):
        whole = rf"(?is)\A(?:{_ELEMENT.replace(chr(92) + '3', chr(92) + '2')})\z"

        def rewrite(x):
            tag = x["tag"]
            linked = let(x["piece"], lambda p: link_attr(p, tag))
            inline = let(linked, style_attrs)
            return let(inline, lambda p: style_text(p, tag))

        candidate = {"piece": piece, "tag": _tag_name(piece)}
        return F.when(
            piece.startswith("<") & piece.rlike(whole), let(candidate, rewrite)
        ).otherwise(piece)

    # Runs that start with text are never elements; runs that start with "<"
    # are told apart by matching them as one.
    pieces = F.regexp_extract_all(as_col(html), F.lit(_PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, of_piece), "")
