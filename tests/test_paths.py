import posixpath
import random

from pyspark.sql import functions as F

from webframe.functions import paths as P
from webframe.functions.urls import hostname  # noqa: F401
from webframe.operators.pathset import resolve_dir_conflicts, save_path

HTML = "text/html"
SAVE = [
    ("http://e.com/a/b", HTML, "../../../x", "", "../x"),
    ("http://e.com/a%20b/c%C3%A4?q#f", HTML, None, "", "e.com/a b/cä"),
    ("http://e.com/a/./b/../c", HTML, None, "", "e.com/a/c"),
    ("http://e.com//a//b.txt", HTML, None, "", "e.com/a/a/b.txt"),
    ("http://[::1]:80/x", HTML, None, "", "::1/x"),
    ("/only/path", HTML, None, "p", "p/only/path"),
]


def test_save_path(evaluate):
    got = evaluate(
        [r[:4] for r in SAVE], ["u", "m", "f", "p"], lambda: save_path("u", "m", "f", F.col("p"))
    )
    for row, have in zip(SAVE, got):
        assert have == row[4], row


def test_save_path_of_parts(evaluate):
    """Folder, host, directories and name put together at random."""
    rng, rows = random.Random(4), []
    kinds = {"text/html": "html", "text/css": "css", "image/gif": "gif", "no/such": "html"}
    for _ in range(400):
        host, port = rng.choice(["elk.test", "ox.emu.test"]), rng.choice(["", ":8123"])
        folders = [rng.choice(["m", "n.o", "p-q", "r_s"]) for _ in range(rng.randrange(4))]
        name, mime = rng.choice(["", "t", "u.tar.gz"]), rng.choice(list(kinds))
        given, parent = rng.choice([None, None, "v w.pdf"]), rng.choice(["", "k", "/k/l"])
        query = rng.choice(["", "?x=1", "?y=/z"])
        url = f"{rng.choice(['http', 'https', 'gopher'])}://{host}{port}/{''.join(f + '/' for f in folders)}{name}{query}"
        last = given or name or f"index.{kinds[mime]}"
        rows.append((url, mime, given, parent, posixpath.join(parent, host, *folders, last)))
    rows += [("", HTML, None, "k", ""), ("gopher://", HTML, None, "k", ""), ("http://elk.test:emu", HTML, None, "k", "")]
    got = evaluate([r[:4] for r in rows], ["u", "m", "f", "p"], lambda: save_path("u", "m", "f", F.col("p")))
    assert list(zip(rows, got)) == [(r, r[4]) for r in rows]


def test_clean_path_agrees_with_posix(evaluate):
    rows = ["", "/", "//", "a", "a/", "/a/b/../c", "../..", "a/../..", "/..", "/../a", "./a/./b", "a//b///c/", "..", ".", "/.", "a/b/../../.."]
    want = [posixpath.normpath(r).replace("//", "/") if r else "." for r in rows]
    assert evaluate([(r,) for r in rows], ["p"], lambda: P.clean_path("p")) == want


def test_base_and_dir(evaluate):
    rows = [("", ".", "."), ("/", "/", "/"), ("//", "/", "/"), ("/a/b", "b", "/a"), ("/a/b/", "b", "/a/b"), ("a", "a", "."), ("a/b//", "b", "a/b")]
    assert evaluate([r[:1] for r in rows], ["p"], lambda: P.base_name("p")) == [r[1] for r in rows]
    assert evaluate([r[:1] for r in rows], ["p"], lambda: P.dir_name("p")) == [r[2] for r in rows]


def test_ancestors(evaluate):
    rows = [
        ("/srv/www/img/x.gif", ["/srv/www/img", "/srv/www", "/srv"]),
        ("/x.gif", []),
        ("www//img/../x.gif", ["www"]),
        ("", []),
        ("file", []),
    ]
    assert evaluate([r[:1] for r in rows], ["p"], lambda: P.ancestors("p")) == [r[1] for r in rows]


def test_relative_path(evaluate):
    rows = [
        ("h/index.html", "h/css/a.css", "css/a.css"),
        ("h/x/y/p.html", "h/z/q.html", "../../z/q.html"),
        ("h/p", "h/q", "q"),
        ("h/p", "h/p", "p"),
        ("h/a/b", "h/a", "."),
        ("/m/h/a/b", "/m/g/c", "../../g/c"),
        ("p", "q/r", "q/r"),
    ]
    got = evaluate([r[:2] for r in rows], ["a", "b"], lambda: P.relative_path("a", "b"))
    assert got == [r[2] for r in rows]
    assert got == [posixpath.relpath("/w/" + b, posixpath.dirname("/w/" + a)) for a, b, _ in rows]


def test_numbered_names(evaluate):
    rows = [("note.md", "note(1).md"), ("note", "note(1)"), (".env", "(1).env"), ("a.tar.gz", "a.tar(1).gz"), ("d.x/file", "d.x/file(1)"), ("$1.t", "$1(1).t")]
    assert evaluate([r[:1] for r in rows], ["p"], lambda: P.numbered_name("p", F.lit(1))) == [r[1] for r in rows]


def test_output_path(evaluate):
    url = [("http://shop.test/cart/list.csv",)]
    assert evaluate(url, ["u"], lambda: P.output_path("u")) == ["list.csv"]
    assert evaluate(url, ["u"], lambda: P.output_path("u", "/out")) == ["/out/list.csv"]
    assert evaluate(url, ["u"], lambda: P.output_path("u", "d", "x.html")) == ["d/x.html"]
    assert evaluate([("http://e.com/a?x=1",)], ["u"], lambda: P.output_path("u")) == ["a?x=1"]


def test_escapes_root(evaluate):
    rows = [("../x", True), ("a/../../x", True), ("a/x", False), ("/x", False), ("..x", False)]
    assert evaluate([r[:1] for r in rows], ["p"], lambda: P.escapes_root("p")) == [r[1] for r in rows]


def test_leaves_folder(evaluate):
    rows = [
        ("/m/h/a", "/m/h", False), ("/etc/passwd", "/m/h", True), ("m/etc/x", "m/h", True), ("/m/hx/a", "/m/h", True),
        ("/m/h", "/m/h", True), ("h/a", "h", False), ("a", "", False), ("../a", "", True), ("/a", "/", False),
    ]
    assert evaluate([r[:2] for r in rows], ["p", "f"], lambda: P.leaves_folder("p", "f")) == [r[2] for r in rows]


def test_nested_directory_conflicts(spark):
    files = ["h/a", "h/a/index.html/b", "h/c", "h/c/d", "h/e/index.html", "h/e/index.html/index.html/f", "h/g", "i"]
    df = spark.createDataFrame([(f, f) for f in files], "raw string, save_path string")
    got = {r.raw: r.save_path for r in resolve_dir_conflicts(df).collect()}
    assert got == {
        **{f: f for f in files}, "h/a": "h/a/index.html/index.html", "h/c": "h/c/index.html",
        "h/e/index.html": "h/e/index.html/index.html/index.html",
    }
    assert not any(a != b and b.startswith(a + "/") for a in got.values() for b in got.values())
