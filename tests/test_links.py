import random

import pytest
from models import css_address
from pyspark.sql import functions as F

from webframe.functions.css import css_url_tokens, css_urls, rewrite_css
from webframe.functions.html import decode_attribute, elements, html_links, rewrite_html

CSS = [
    ("a{b:URL(x.png)}", []),
    ("a{b:myurl(x.png) -url(y) @url(z)}", []),
    ("@import 'x.css'; @import url(y.css);", ["y.css"]),
    ("a{b:url(x.png  )}", ["x.png  "]),
    ("a{b:url(`x.png`)}", ["x.png"]),
    ("a{b:url(\"it's\")} c{d:url(z)}", ["z"]),
    ("a{b:url(\"a)\" b) c} d{e:url(f)}", ["f"]),
    ("a{b:url(data:image/png;base64,AAA=)}", ["data:image/png;base64,AAA="]),
    ("a{b:url(x", []),
    ("/* open url(x)", []),
    ("", []),
]


def test_css_urls(evaluate):
    got = evaluate([r[:1] for r in CSS], ["c"], lambda: css_urls("c"))
    for (css, want), have in zip(CSS, got):
        assert have == want, css


def test_addresses_in_tokens(evaluate):
    """Sheets of one rule with a random token against a model that tries all readings of it."""
    rng, rows = random.Random(8), []
    parts = ["x", "y.png", " ", "\t", "url", "url(", "URL(", ")", "(", "'", "`", "/a?b=1", "é", "%20"]
    for _ in range(3000):
        quote = rng.choice(["'", '"', ""])
        inside = "".join(rng.choices(parts, k=rng.randrange(7)))
        inside = inside.replace(quote, "") if quote else "".join(c for c in inside if c not in "'\"() \t")
        if not quote and inside.startswith("`"):
            continue
        token = f"url({rng.choice(['', ' '])}{quote}{inside}{quote}{rng.choice(['', ' '])})"
        rows.append((token, css_address(token)))
    want = [[] if w is None else [w] for _, w in rows]
    assert sum(not w for w in want) > 20 and len({str(w) for w in want}) > 500
    sheets = [(f"a{{b:{token} 1px}} c{{d:'url(no)'}}",) for token, _ in rows]
    got = evaluate(sheets, ["c"], lambda: css_urls("c"))
    assert list(zip(sheets, got)) == list(zip(sheets, want))
    new = evaluate(sheets, ["c"], lambda: rewrite_css("c", lambda u: F.concat(F.lit("<"), u, F.lit(">"))))
    for (sheet,), have, found in zip(sheets, new, want):
        assert have.replace("<", "").replace(">", "") == sheet and have.count("<") == len(found)
        assert not found or f"<{found[0]}>" in have


def test_css_tokens(evaluate):
    got = evaluate([("a{b:url( 'x' ) URL(y) /*url(z)*/}",)], ["c"], lambda: css_url_tokens("c"))
    assert got == [["url( 'x' )", "URL(y)"]]


def test_rewrite_css(evaluate):
    def suffix(u):
        return F.concat(u, F.lit("(2)"))

    rows = [("a{b:url(x", "a{b:url(x"), ("p{q:url(r)}s{t:URL(u)}", "p{q:url(r(2))}s{t:URL(u)}"), ("", "")]
    assert evaluate([r[:1] for r in rows], ["c"], lambda: rewrite_css("c", suffix)) == [r[1] for r in rows]
    same = [r[:1] for r in CSS]
    assert evaluate(same, ["c"], lambda: rewrite_css("c", lambda u: u)) == [r[0] for r in same]

    def no_data(u):
        return F.when(u.startswith("data:"), u).otherwise(suffix(u))

    text = "a{b:url(data:text/plain,hi)} c{d:url(e)}"
    assert evaluate([(text,)], ["c"], lambda: rewrite_css("c", no_data)) == [text.replace("(e)", "(e(2))")]


HTML = [
    ("<p>no links</p>", []),
    ("<ul><li><a href='/one'>1</a><li><a href=\"/two\">2</a></ul>", ["/one", "/two"]),
    ("<figure><img src=pic.webp></figure><link href=feed.xml rel=alternate>", ["pic.webp", "feed.xml"]),
    ("<style>i{c:url(bg.gif)}</style><embed src=no><object data=no></object>", ["bg.gif"]),
    ("<A HREF=x.html>y</A><IMG alt='>' SRC=\"z\">", ["x.html", "z"]),
    ("<a href=one href=two>", ["one"]),
    ("<a href>x</a><a href=''>y</a>", ["", ""]),
    ("<a title=it's href='q'>", ["q"]),
    ("<a data-href='no' href='yes'>", ["yes"]),
    ("<!-- <a href='no'> --><a href='yes'><!--><a href='yes2'>", ["yes", "yes2"]),
    ("<script>var t='<a href=\"no\">';</script><a href=yes>", ["yes"]),
    ("<textarea><a href=no></textarea><title><img src=no></title><noscript><img src=no></noscript><a href=yes>", ["yes"]),
    ("<div style=\"b:url(&quot;y.png&quot;)\"></div>", ["y.png"]),
    ("<a style='b:url(2)' href=1><style style='b:url(4)'>a{b:url(3)}</style>", ["1", "2", "3", "4"]),
    ("<a href='?a=1&amp;b=2&copy=3&lt'>", ["?a=1&b=2&copy=3<"]),
    ("<a href='x'", []),
    ("<a href=1><p title=\"<a href=2>", ["1"]),
    ("<style></style><a href=x>", ["x"]),
    ("<script src=no></script><video src=no></video><iframe src=no></iframe>", []),
    ("<image src=old>", ["old"]),
    ("<a/href=slash>", ["slash"]),
    ("5 < 6 <a href=ok> </ bogus><a href=ok2>", ["ok", "ok2"]),
    ("<textarea style='a:url(u)'><a href=no></textarea>", ["u"]),
    ("<plaintext><a href=no>", []),
    ("<p style='a:url(1)' style='b:url(2)'>", ["1", "2"]),
    ("<style>a{b:url(x)}", ["x"]),
    ("", []),
]


def test_html_links(evaluate):
    got = evaluate([r[:1] for r in HTML], ["h"], lambda: html_links("h"))
    for (html, want), have in zip(HTML, got):
        assert [x["url"] for x in have] == want, html


def test_link_kinds(evaluate):
    html = "<A href=1 style='x:url(2)'><style>x{y:url(3)}</style><img src=4>"
    got = evaluate([(html,)], ["h"], lambda: html_links("h"))[0]
    assert [(x["kind"], x["tag"], x["url"]) for x in got] == [
        ("attr", "a", "1"), ("style_attr", "a", "2"), ("style_element", "style", "3"), ("attr", "img", "4"),
    ]


def test_entities(evaluate):
    rows = [
        ("a&amp;b", "a&b"), ("&#39;&#x27;&#X27", "'''"), ("&eacute;&nbsp;", "é "), ("&copy=1", "&copy=1"),
        ("&copyx", "&copyx"), ("&copy.", "©."), ("&bogus;", "&bogus;"), ("&#0;&#xD800;&#x110000;", "���"),
        ("&#128;", "€"), ("&#x1F600;", "😀"), ("&", "&"), ("&NotEqualTilde;", "≂̸"), ("&#99999999999999999999;", "�"),
    ]
    got = evaluate([r[:1] for r in rows], ["v"], lambda: decode_attribute(F.col("v")))
    assert got == [r[1] for r in rows]


REWRITE = [
    ("<style>i{c:url(bg.gif)}</style>url(text)", "<style>i{c:url(bg.gif.2)}</style>url(text)"),
    ("<i style='c:url(\"q.gif\")'>url(q.gif)</i>", "<i style='c:url(\"q.gif.2\")'>url(q.gif)</i>"),
    ("<i style=\"c:url(`t`)\">", "<i style=\"c:url(`t.2`)\">"),
    ("<img src=1 alt='2'><script src=3></script><link href='4'>", "<img src=\"1.2\" alt='2'><script src=3></script><link href='4.2'>"),
    ("", ""),
    ("<a href=x&amp;y>t</a>", '<a href="x&amp;y.2">t</a>'),
    ("<a href='a' style='b:url(c)' href='d'>", "<a href='a.2' style='b:url(c.2)' href='d'>"),
    ("<a href>t</a>", '<a href=".2">t</a>'),
]


def test_rewrite_html(evaluate):
    got = evaluate(
        [r[:1] for r in REWRITE], ["h"], lambda: rewrite_html("h", lambda u, is_a: F.concat(u, F.lit(".2")))
    )
    for (html, want), have in zip(REWRITE, got):
        assert have == want, html


def test_rewrite_is_a(evaluate):
    html = "<a href=1 style='x:url(2)'><img src=3>"
    got = evaluate([(html,)], ["h"], lambda: rewrite_html("h", lambda u, a: F.when(a, F.lit("A")).otherwise(u)))
    assert got == ["<a href=\"A\" style='x:url(2)'><img src=3>"]


def test_identity_keeps_every_byte(spark, sf, evaluate):
    rows = [r[:1] for r in HTML]
    assert evaluate(rows, ["h"], lambda: rewrite_html("h", lambda u, a: u)) == [r[0] for r in rows]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert pages.where(rewrite_html("html", lambda u, a: u) != F.col("html")).count() == 0


def test_identity_on_random_text(spark):
    rng = random.Random(11)
    css = ["url(", "URL(", ")", "'", '"', "`", "\\", "/*", "*/", "a", " ", "\n", "{", "@import", "é", "\\26 "]
    html = ["<", ">", "<a href=", "<style>", "</style>", " style='", '"', "'", "=", "url(x)", "<!--", "-->", "&amp;", "p", " ", "/", "<script>", "é"]
    rows = [(k, "".join(rng.choices(css if k % 2 else html, k=rng.randrange(1, 14)))) for k in range(20_000)]
    rows += [(20_001, "a{b:url(\\"), (20_003, "url('x\\")]
    df = spark.createDataFrame(rows, "k int, t string")
    same = F.when(F.col("k") % 2 == 1, rewrite_css("t", lambda u: u)).otherwise(rewrite_html("t", lambda u, a: u))
    assert df.where(same != F.col("t")).select("t").collect() == []


def test_extract_of_rewrite(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    new = rewrite_html("html", lambda u, a: F.concat(F.lit("/n"), u))
    a = F.transform(html_links("html"), lambda x: F.concat(F.lit("/n"), x["url"]))
    b = F.transform(html_links("new"), lambda x: x["url"])
    both = pages.withColumn("new", new).select(a.alias("a"), b.alias("b"))
    assert both.where(F.size("a") > 0).count() > 0
    assert both.where(F.col("a") != F.col("b")).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_long_input_needs_no_deep_stack(evaluate, n):
    tag = "<div " + "".join(f'a{i}="x" ' for i in range(n)) + ">"
    text = tag + "<a href=end>" + "<p>" * n + "<!--" + "-" * n
    assert [x["url"] for x in evaluate([(text,)], ["h"], lambda: html_links("h"))[0]] == ["end"]
    css = "a{b:url(x)}" + "\\a " * n + "url(y)" + "'" + "\\'" * n
    assert evaluate([(css,)], ["c"], lambda: F.size(css_urls("c"))) == [1]
    assert len(evaluate([(text,)], ["h"], lambda: elements("h"))[0]) == 1
