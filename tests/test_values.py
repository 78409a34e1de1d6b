import random

import pytest
from pyspark.sql import functions as F

from models import disposition, rate

from webframe.functions import globs as G
from webframe.functions import headers as H
from webframe.functions import sizes as Z
from webframe.options import MirrorOptions

MAP = "h map<string,array<string>>"


def test_mime_type(evaluate):
    """Types, blanks and parameters put together at random; only the first value of the header counts."""
    rng, rows = random.Random(2), []
    for _ in range(300):
        kind = f"{rng.choice(['font', 'model', 'x-own', 'Image'])}/{rng.choice(['a', 'b+zip', 'vnd.c.d', 'E'])}"
        pad = ["".join(rng.choices(" \t", k=rng.randrange(3))) for _ in range(2)]
        rest = "".join(f";{rng.choice([' ', ''])}{k}={rng.randrange(9)}" for k in rng.sample("pqr", rng.randrange(3)))
        others = [f"other/{k}" for k in range(rng.randrange(3))]
        rows.append(({rng.choice(["Content-Type", "CONTENT-type"]): [pad[0] + kind + pad[1] + rest, *others]}, kind))
    rows += [({"X-Type": ["font/a"]}, ""), ({"Content-Type": [" ; p=1"]}, ""), ({"content-type": []}, "")]
    assert evaluate([r[:1] for r in rows], ["h"], lambda: H.mime_type("h"), [MAP]) == [r[1] for r in rows]


def test_content_length(evaluate):
    rows = [(["1234"], 1234), (["  5678  "], 5678), (["1000", "2000"], 1000), (None, -1), ([""], -1), (["abc"], -1), (["1.0"], -1), (["99999999999999999999"], -1)]
    got = evaluate([({"CONTENT-LENGTH": r[0]} if r[0] else {},) for r in rows], ["h"], lambda: H.content_length("h"), [MAP])
    assert got == [r[1] for r in rows]


def test_disposition(evaluate):
    """Values of random parts against a model that tries all readings."""
    rng = random.Random(11)
    parts = [*["filename"] * 6, "FileName", "FILENAME", *["="] * 8, "name", " ", "  ", "\t", '"', ";", "; ", "report", "7.csv", "é", "*", "\\", "%20", "\n", "attachment"]
    values = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(20_000)]
    values += [f"{w}filename{a}={b}{c}" for w in ("", "x;") for a in ("", " ") for b in ("", " ", "\t ") for c in ("", '"', ";", '"";filename=z', "; filename=z", "filename=z")]
    want = list(map(disposition, values))
    assert len({w for w in want if w}) > 900 and want.count(None) > 1000
    got = evaluate([(v,) for v in values], ["d"], lambda: H.filename_of("d"))
    assert [(v, g) for v, g in zip(values, got)] == list(zip(values, want))
    maps = [({"Content-DISPOSITION": [values[-1], "filename=no"]},), ({"Content-Disposition": []},)]
    assert evaluate(maps, ["h"], lambda: H.disposition_filename("h"), [MAP]) == [disposition(values[-1]), None]


def test_extension(evaluate):
    rows = [("text/css", "css"), ("image/svg+xml", "svg"), ("application/x-gzip", "gz"), ("x/y", "html"), ("", "html")]
    assert evaluate([r[:1] for r in rows], ["m"], lambda: H.mime_extension("m")) == [r[1] for r in rows]


def test_parse_rate(evaluate):
    rng, rows = random.Random(5), []
    for _ in range(500):
        whole, digits = rng.randrange(10 ** rng.randrange(1, 9)), "".join(rng.choices("0123456789", k=rng.randrange(4)))
        unit = rng.choice(["", "k", "M", " ", "K", "m", "kB", "G", "%"])
        rows.append((f"{whole}{'.' * bool(digits)}{digits}{unit}", rate(whole, digits, unit)))
    rows += [("-1.5", -2), ("1e3", 1000), ("1_0", 0), ("x8", 0), ("8 k", 0), (".5k", 0), ("8..1", 0), ("９", 0), ("9" * 30, 0)]
    assert evaluate([r[:1] for r in rows], ["t"], lambda: Z.parse_rate("t")) == [r[1] for r in rows]


def test_format_size(evaluate):
    rows = [
        (0, "0 B"), (1, "1 B"), (3 << 10, "3.00 KiB"), (5 << 20, "5.00 MiB"), (7 << 30, "7.00 GiB"), ((1 << 20) - 1, "1024.00 KiB"),
        ((1 << 30) - 1, "1024.00 MiB"), (-1, "--.- B"),
        (1500, "1.46 KiB"), (1152, "1.12 KiB"), (1408, "1.38 KiB"),
    ]
    assert evaluate([r[:1] for r in rows], ["n"], lambda: Z.format_size("n"), ["n bigint"]) == [r[1] for r in rows]


def test_round_bytes(evaluate):
    rows = [(56370, "0.06MB"), (2_000_000_000, "2.00GB"), (15_000, "0.01MB"), (5_000, "0.01MB"), (999_999_999, "1000.00MB")]
    got = evaluate([r[:1] for r in rows], ["n"], lambda: Z.round_bytes("n"), ["n bigint"])
    assert got == [r[1] for r in rows] == [f"{n / 1e6:.2f}MB" if n < 1e9 else f"{n / 1e9:.2f}GB" for n, _ in rows]


def test_percent_and_eta(evaluate):
    cols = ["a bigint", "b bigint", "c bigint"]
    rows = [(1, 3, 0), (5, 5, 0), (7, 0, 0), (7, -1, 0)]
    assert evaluate(rows, ["a"], lambda: Z.percent_complete("a", "b"), cols) == ["33.33%", "100.00%", "--.-%", "--.-%"]
    rows = [(0, 10, 1), (1, -1, 1), (5, 10, 0), (100, 3700, 1), (10, 100, 60), (10, 10, 1), (1, 3724, 1), (1, 62, 1)]
    clock = "\U0001f55b"
    want = [clock, clock, clock, "1h0m0s", "1s", "0s", "1h2m3s", "1m1s"]
    assert evaluate(rows, ["a"], lambda: Z.eta("a", "b", "c"), cols) == want


@pytest.mark.parametrize(
    ("pattern", "is_reject", "regex"),
    [
        ("jpg", True, ".*jpg$"), (".jpg", True, r"\.jpg"), ("*.jpg", True, r".*\.jpg"), ("/js", False, "^/?/js.*"),
        ("hello-[1-3]-?.*.png", True, r"hello-[1-3]-.?\..*\.png"), ("js", False, "^/?js.*"), ("/a*", False, "/a.*"),
        ("", True, ".*$"), ("[", True, r"\["), ("[z-a]", True, None),
    ],
)
def test_compile_glob(pattern, is_reject, regex):
    assert G.compile_glob(pattern, is_reject) == regex


def test_limits(evaluate):
    rows = [("/a/b.jpg",), ("/a/b.jpgx",), ("/a/jpg/c",), ("",), ("/",), ("/a/b\n",), ("/a/[x&&y].t",)]
    assert evaluate(rows, ["p"], lambda: G.should_reject("p", ["jpg"])) == [True, False, False, False, False, False, False]
    assert evaluate(rows, ["p"], lambda: G.should_reject("p", [".jpg"])) == [True, True, False, False, False, False, False]
    assert evaluate(rows, ["p"], lambda: G.should_exclude("p", ["/a"])) == [True, True, True, False, False, True, True]
    assert evaluate(rows, ["p"], lambda: G.should_exclude("p", ["a"])) == [True, True, True, False, False, True, True]
    assert evaluate(rows, ["p"], lambda: G.should_reject("p", [""])) == [True] * 7
    assert evaluate(rows, ["p"], lambda: G.should_reject("p", [])) == [False] * 7
    assert evaluate(rows, ["p"], lambda: G.should_reject("p", ["[[]x*"])) == [False] * 6 + [True]


def test_options():
    for bad in ({"mirror": False, "convert_links": True}, {"mirror": False, "rejects": ("a",)}, {"output_file": "x"}, {"base_mode": "x"}):
        with pytest.raises(ValueError):
            MirrorOptions(**bad)
    with pytest.warns(UserWarning):
        MirrorOptions(rejects=("",))


def test_status_lines(spark):
    rows = [
        ("start", None, None, None, None), ("status", "200 OK", None, None, None), ("status", None, None, None, None),
        ("length", None, -1, None, None), ("length", None, 2_000_000, None, None), ("file", None, None, "a/b", None),
        ("finished", None, None, None, ""), ("finished", None, None, None, "u"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, s string, n bigint, p string, u string")
    at = F.timestamp_seconds(F.lit(0))
    line = Z.status_lines(F.col("k"), at, F.col("s"), F.col("n"), F.col("p"), F.col("u"))
    assert [r[0] for r in df.orderBy("i").select(line).collect()] == [
        "start at 1970-01-01 00:00:00", "sending request, awaiting response... status 200 OK",
        "sending request, awaiting response... ", "content size: unspecified [~--.- B]", "content size: 2000000 [~2.00MB]",
        "saving file to: a/b", "failed at 1970-01-01 00:00:00", "Downloaded [u] finished at 1970-01-01 00:00:00",
    ]
