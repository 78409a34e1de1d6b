import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from webframe.functions import urls
from webframe.functions.paths import clean_slash, trim_slash

RESOLVE = [
    ("http://h/a/index.html", "b.html", "http://h/a/index.html/b.html"),
    ("https://m/en/25#top", "#top", "https://m/en/25/#top"),
    ("http://h/fr/825?page=2", "/für", "http://h/f%C3%BCr"),
    ("http://h/a", "//cdn/x//y", "http://cdn/x/y"),
    ("http://h/a", "mailto:a@b.c", None),
    ("http://h/a?q=1#f", "", "http://h/a/?q=1#f"),
    ("http://h/a?q=1#f", "?z=2", "http://h/a/?z=2"),
    ("http://h/a?q=1#f", "?", "http://h/a/?"),
    ("http://h", "x", "http://h/x"),
    ("http://h/a", "/../../x", "http://h/x"),
    ("http://h/a", "b/./c/../d", "http://h/a/b/d"),
    ("http://h/a(b)", "c", "http://h/a%28b%29/c"),
    ("http://h/a(b)/", "c", "http://h/a(b)/c"),
    ("http://h/a", "b%2fc%c3%a4", "http://h/a/b%2fc%c3%a4"),
    ("http://h/a", "b%7Ec//d%c3%a4", "http://h/a/b~c/d%C3%A4"),
    ("http://h/a", "x y", "http://h/a/x%20y"),
    ("http://h/a", "HTTP://Other/X", "http://Other/X"),
    ("http://h/a", "1:2", None),
    ("http://h/a", "x%zz", None),
    ("http://h/a", "//other", "http://other"),
    ("http://u:p@h:81/a", "b", "http://u:p@h:81/a/b"),
    ("http://für.de/a", "/b", "http://f%C3%BCr.de/b"),
]


def test_resolve(evaluate):
    got = evaluate([r[:2] for r in RESOLVE], ["p", "l"], lambda: urls.absolute_url("p", "l"))
    for (p, l, want), have in zip(RESOLVE, got):
        # One trailing slash more is the same address.
        assert have == want or (have or "").removesuffix("/") == want, (p, l, have)


def test_resolve_like_the_standard_library(evaluate):
    """On plain paths a page URL taken as a directory is a base that ends in a slash."""
    bases = [f"https://shop.test{p}" for p in ("", "/tools", "/tools/hammers", "/tools/hammers/steel", "/x.y/z")]
    links = ["nails", "./nails", "../nails", "../../saws/2", "../../../..", "/home", "//cdn.test/i.png", "http://other.test/a/b", "a/../b/./c", "n?size=3", "n#top"]
    rows = [(b, k) for b in bases for k in links]
    got = evaluate(rows, ["p", "l"], lambda: urls.absolute_url("p", "l"))
    for (base, link), have in zip(rows, got):
        assert have.rstrip("/") == urljoin(base.rstrip("/") + "/", link).rstrip("/"), (base, link)
    odd = [("https:://shop.test/a", "b", None), ("https:///shop.test/a//b", "c", "https://shop.test/a/b/c")]
    assert evaluate([r[:2] for r in odd], ["p", "l"], lambda: urls.absolute_url("p", "l")) == [r[2] for r in odd]


def test_resolve_rfc3986(evaluate):
    rows = [
        ("http://h/a/index.html", "b.html", "http://h/a/b.html"),
        ("http://h/a/b/", "../c", "http://h/a/c"),
        ("http://h/a?x", "#f", "http://h/a?x#f"),
        ("http://h", "c", "http://h/c"),
    ]
    got = evaluate([r[:2] for r in rows], ["p", "l"], lambda: urls.absolute_url("p", "l", "rfc3986"))
    assert got == [r[2] for r in rows]


CLEAN = [
    ("http://h/a?b//c", "http://h/a?b//c"),
    ("http://h/a#", "http://h/a"),
    ("http://h/a\tb", None),
    ("http://h h/a", None),
    ("http://[::1]:80/a//b", "http://[::1]:80/a/b"),
    ("http://[::1/a", None),
    ("///x//y", "/x/y"),
    ("http://h/%2F%2Fa", "http://h/a"),
    ("a%3Ab//c", "./a:b/c"),
    ("http://h/a#ü", "http://h/a#%C3%BC"),
]


def test_clean_url(evaluate):
    got = evaluate([r[:1] for r in CLEAN], ["u"], lambda: urls.clean_url("u"))
    for (u, want), have in zip(CLEAN, got):
        assert have == want, u


def test_runs_of_slashes(evaluate):
    paths = ["/".join(["", *["/" * (k % (n + 1)) + w for k, w in enumerate(("blue", "green", "red")[:n])]]) + "/" * n for n in (1, 2, 3)]
    rows = [f"{scheme}{'/' * extra}shop.test{path}" for scheme in ("http://", "https://") for extra in (0, 1, 2) for path in paths]
    got = evaluate([(r,) for r in rows], ["u"], lambda: urls.clean_url("u"))
    assert got == [re.sub(r"(?<!:)/+", "/", re.sub(r"^(\w+:)/+", r"\1//", r)) for r in rows]


def test_clean_slash(evaluate):
    rows = [("//srv///www//", "/srv/www/"), ("www/", "www/"), ("", ""), ("/", "/"), ("a///b", "a/b")]
    assert evaluate([r[:1] for r in rows], ["u"], lambda: clean_slash("u")) == [r[1] for r in rows]
    assert evaluate([("a/",), ("a//",), ("a",)], ["u"], lambda: trim_slash("u")) == ["a", "a/", "a"]


SAME_HOST = [
    ("http://shop.test/a?b", "https://shop.test/c#d", True),
    ("http://shop.test", "http://shop.text", False),
    ("http://shop.test:81/", "http://shop.test:82/", False),
    ("http://m.shop.test", "http://shop.test", False),
    ("https://shop.test", "http://[bad", False),
    ("", "", True),
    ("https://shop.test", "", False),
    ("http://E.com", "http://e.com", False),
]


def test_same_host(evaluate):
    got = evaluate([r[:2] for r in SAME_HOST], ["a", "b"], lambda: urls.same_host("a", "b"))
    assert got == [r[2] for r in SAME_HOST]


def seeds(rng):
    """A typed seed, its URL and its error, from parts whose effects are known each for itself."""
    scheme = rng.choice(["", "", "http://", "https://"])
    labels = [rng.choice(["ox", "elk", "emu7", "n-gnu"]) for _ in range(rng.randrange(1, 4))]
    host = ".".join([*labels, rng.choice(["test", "invalid"])]) if rng.random() < 0.8 else labels[0]
    port = rng.choice(["", "", ":80", ":443", ":8123"])
    path = rng.choice(["", "/", "/m/n.o", "/m?n=o:p"])
    typed, start = scheme + host + port + path, scheme or "https://"
    dotted = "." in host
    if not scheme and port in (":80", ":443") and not path:
        # A well-known port alone stands for the scheme.
        return typed, ({":80": "http://", ":443": "https://"}[port] + host) if dotted else None, None if dotted else "invalid domain format"
    if not scheme and port in (":80", ":443"):
        return None
    return (typed, start + host + port + path, None) if dotted else (typed, None, "invalid domain format")


def test_validate(evaluate):
    rng = random.Random(6)
    rows = [r for r in (seeds(rng) for _ in range(800)) if r]
    rows += [
        ("localhost:9/z", "http://localhost:9/z", None), ("127.0.0.1", "http://127.0.0.1", None), ("/m.test", None, "relative path"),
        ("https://", None, "host missing"), ("https://.m.test", None, "wrong host format"), ("-m.test", None, "wrong host format"),
        ("m\x01.test", None, "invalid URL"), ("https://m.test/%4", None, "invalid URL"), ("m.test#n", None, "invalid URL"),
        ("https://m.test/#n", "https://m.test/#n", None), ("https://[m.test", None, "invalid URL"), ("https://m.test:n", None, "invalid URL"),
    ]
    got = evaluate([r[:1] for r in rows], ["u"], lambda: urls.validate_url("u"))
    for (u, url, error), have in zip(rows, got):
        assert (have["error"], have["url"], have["valid"]) == (error, url, error is None), u


def test_default_scheme(evaluate):
    rows = [
        ("shop.org/x", "http://shop.org/x"),
        ("https://e.com/ä", "https://e.com/%C3%A4"),
        ("//e.com/x", "http://e.com/x"),
        ("http://e.com:xx", None),
        ("localhost:8080", "localhost:8080"),
    ]
    got = evaluate([r[:1] for r in rows], ["u"], lambda: urls.with_default_scheme("u"))
    assert got == [r[1] for r in rows]


def test_parse_parts(evaluate):
    got = evaluate([("HTTP://u@h.com:8/p%20q?x=1#f",)], ["u"], lambda: urls.parse_url("u"))[0]
    assert (got["scheme"], got["userinfo"], got["host"], got["path"], got["query"], got["fragment"], got["error"]) == (
        "http", "u", "h.com:8", "/p%20q", "?x=1", "#f", False)
    assert evaluate([("http://h/p%20q+r",)], ["u"], lambda: urls.url_path("u")) == ["/p q+r"]
    assert evaluate([("http://[::1]:8/",), ("http://h:8/",)], ["u"], lambda: urls.hostname(urls.url_host("u"))) == ["::1", "h"]
    assert evaluate([("http://h/a#b",)], ["u"], lambda: urls.drop_fragment(F.col("u"))) == ["http://h/a"]
