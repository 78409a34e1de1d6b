import random

import pytest
from pyspark.sql import functions as F

from webframe.options import MirrorOptions
from webframe.plans import views
from webframe.plans.site_mirror import Hooks, mirror
from webframe.operators.transfers import average_rates, mirror_summary, next_average, rate_per_second
from webframe.sources.bodies import read_bodies
from webframe.sources.snapshots import follow_redirects, latest_responses, with_redirects
from webframe.sources.versions import Site


# Redirects -----------------------------------------------------------------


def walk(hops, url, most):
    at, n = hops[url], 1
    while at in hops:
        at, n = hops[at], n + 1
        if n > most:
            return url, None, None, "too_many_redirects"
    return (url, at, n, None) if at is not None else (url, None, None, "too_many_redirects")


@pytest.mark.parametrize("most", [1, 2, 10, 100])
def test_redirects_against_a_walk(spark, most):
    rng = random.Random(most)
    hops = {f"c{i}": f"c{i + 1}" for i in range(130)}
    hops |= {f"r{i}": f"r{(i + 1) % 7}" for i in range(7)} | {"self": "self", "in": "r3"}
    hops |= {f"h{i}": "c120" for i in range(300)}
    hops |= {f"x{i}": f"x{rng.randrange(90)}" for i in range(60)}
    got = follow_redirects(spark.createDataFrame(list(hops.items()), "url string, target string"), most)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((walk(hops, u, most) for u in hops), key=repr)


def test_no_redirects(spark):
    assert follow_redirects(spark.createDataFrame([], "url string, target string")).count() == 0


def responses(spark, rows, more=""):
    schema = f"url string, status int, mime string, declared_length long, filename string, body_length long, body string{more}"
    return spark.createDataFrame(rows, schema)


def page(url, body, status=200, mime="text/html", location=None):
    return url, status, mime, -1, None, len(body), body, location


def test_mirror_follows_redirects(spark):
    snapshot = responses(spark, [
        page("http://h/", "<a href=/old><a href=/loop><a href=/lost><a href=/b>"), page("http://h/old", "", 302, location="new"),
        page("http://h/new", "<a href=/c>", 301, location="http://h/end"), page("http://h/end", "<a href=/d>the end"),
        page("http://h/loop", "", 307, location="/loop"), page("http://h/lost", "", 302, location="/gone"),
        page("http://h/b", "b", 302), page("http://h/d", "d"),
    ], ", location string")
    done = mirror(snapshot, spark.createDataFrame([(1, "http://h/")], "seed_id long, url string"))
    got = {r.url: (r.error, r.final_url) for r in done.results.collect()}
    assert got == {
        "http://h/": (None, "http://h/"), "http://h/old": (None, "http://h/end"), "http://h/loop": ("too_many_redirects", None),
        "http://h/lost": ("not_found", "http://h/gone"), "http://h/b": ("bad_status", "http://h/b"),
        # The page is saved under the URL that was asked for, which its links count from; /c is behind a redirect and not seen.
        "http://h/d": (None, "http://h/d"),
    }
    assert {(r.url, r.final_url) for r in done.manifest().collect()} == {("http://h/", "http://h/"), ("http://h/old", "http://h/end"), ("http://h/d", "http://h/d")}
    bodies = {r.url: r.body for r in done.saved_site().collect()}
    assert bodies["http://h/old"] == "<a href=/d>the end"


def test_redirected_rows_keep_their_columns(spark):
    snapshot = responses(spark, [page("http://h/a", "x", 301, location="b"), page("http://h/b", "y")], ", location string")
    got = with_redirects(snapshot)
    assert got.columns == [*snapshot.columns[:-1], "final_url", "redirect_error"]
    assert {r.url: (r.status, r.body) for r in got.collect()} == {"http://h/a": (200, "y"), "http://h/b": (200, "y")}


def test_latest_responses(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(30)}", rng.choice([None, 1, 2, 3]), k, f"body {k}") for k in range(300)] + [("u1", 3, 999, "last")] * 2
    got = latest_responses(spark.createDataFrame(rows, "url string, at int, k int, body string"), "at", "k").collect()
    want = {}
    for u, at, k, body in rows:
        want[u] = max(want.get(u, (-1, -1, "")), (at or 0, k, body))
    assert {r.url: (r.at or 0, r.k, r.body) for r in got} == want and len(got) == len(want)


# Hooks and progress --------------------------------------------------------


def site(spark):
    return responses(spark, [
        page("http://h/", "<a href=/a><a href=/b><img src=/i.png>")[:-1], page("http://h/a", "<a href=/c>")[:-1],
        page("http://h/b", "<a href=/d>")[:-1], page("http://h/c", "c")[:-1], page("http://h/d", "d")[:-1],
        page("http://h/i.png", "png", mime="image/png")[:-1],
    ])


def run(spark, **kw):
    return mirror(site(spark), spark.createDataFrame([(1, "http://h/")], "seed_id long, url string"), MirrorOptions(save_path="m"), **kw)


def test_hooks(spark):
    own = F.concat(F.lit("flat/"), F.regexp_replace("url", "[^a-z]+", "_"))
    done = run(spark, hooks=Hooks(save_path=own))
    assert {r.save_path for r in done.saved.collect()} == {"flat/http_h_" + x for x in ("", "a", "b", "c", "d", "i_png")}
    done = run(spark, hooks=Hooks(traverse=~F.col("url").endswith("/b")))
    assert {r.url[9:] for r in done.reached.collect()} == {"", "a", "b", "c", "i.png"}
    done = run(spark, hooks=Hooks(keep=F.when(F.col("mime") == "image/png", F.lit(None)).otherwise(~F.col("url").endswith("/a"))))
    results = {r.url[9:]: (r.keep, r.error) for r in done.results.collect()}
    # HTML is followed although it is not kept; an image that is not kept is not even read.
    assert results["a"] == (False, None) and results["i.png"] == (False, "skipped") and "c" in results
    assert {r.url[9:] for r in done.saved.collect()} == {"", "b", "c", "d"}


def test_progress_is_what_the_summary_says(spark, sf):
    heard = []
    done = mirror(views.site(spark, sf), views.site_seeds(spark, sf), MirrorOptions(rejects=("*5",)), progress=heard.append)
    results = done.results
    levels = [e for e in heard if e["step"] == "level"]
    assert {e["depth"]: e["urls"] for e in levels if e["urls"]} == {r.depth: r["count"] for r in results.groupBy("depth").count().collect()}
    taken = F.when(F.col("error").isNull(), F.col("body_length")).otherwise(0)
    summary = mirror_summary(results.select(F.timestamp_seconds("depth").alias("ts"), taken.alias("bytes"))).first()
    (told,) = [e for e in heard if e["step"] == "results"]
    assert (told["files"], told["bytes"]) == (summary.files, summary.bytes) and told["failed"] == results.where("error is not null").count() > 0


# Versions of a saved site --------------------------------------------------


class Killed(Exception):
    pass


def test_readers_see_one_version(spark, tmp_path, monkeypatch):
    target = Site(spark, str(tmp_path / "site"))
    with pytest.raises(FileNotFoundError):
        target.read()
    files = lambda tag: spark.range(50).selectExpr("concat('p', id) as save_path", f"concat('{tag}', id) as body").repartition(5)
    target.publish(files("old"))
    before = target.read()

    def killed(self, name):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(Site, "_commit", killed)
        with pytest.raises(Killed):
            target.publish(files("never"))
    assert {r.body[:3] for r in Site(spark, str(tmp_path / "site")).read().collect()} == {"old"}
    half = spark.range(10).select(F.when(F.col("id") < 9, F.lit("x")).otherwise(F.raise_error(F.lit("lost"))).alias("body"))
    with pytest.raises(Exception, match="lost"):
        target.publish(half)
    assert target.read().count() == 50
    target.publish(files("new"))
    assert {r.body[:3] for r in target.read().collect()} == {"new"} and {r.body[:3] for r in before.collect()} == {"old"}


# Raw bodies ----------------------------------------------------------------


def test_raw_bodies(spark, tmp_path):
    text = "<p>Grüße, naïve façade</p>"
    files = {
        "a/declared.html": (text.encode("latin1"), "text/html; Charset=\"ISO-8859-1\""),
        "a/mark.html": (b"\xef\xbb\xbf" + text.encode(), "text/html"),
        "b/mark16.html": (b"\xff\xfe" + text.encode("utf-16le"), None),
        "b/files/named.html": (f"<html><meta charset=latin1>{text}".encode("latin1"), "text/html"),
        "plain": (text.encode(), None), "broken": (b"a\xffb", "text/html; charset=utf-8"), "odd": (text.encode(), "text/html; charset=klingon"),
        "cut16": ("a€".encode("utf-16le")[:-1], "text/html; charset=utf-16le"), "empty": (b"", None), "unnamed": (b"no row", None),
    }
    for name, (content, _) in files.items():
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_bytes(content)
    rows = [(n, f"http://h/{n}", 200, {"content-TYPE": [t]} if t else {}) for n, (_, t) in files.items() if n != "unnamed"]
    rows.append(("missing", "http://h/missing", 200, {}))
    sidecar = spark.createDataFrame(rows, "path string, url string, status int, headers map<string,array<string>>")
    got = {r.path: r for r in read_bodies(spark, str(tmp_path / "files"), sidecar).collect()}
    assert {k: (r.charset, r.body) for k, r in got.items()} == {
        "a/declared.html": ("iso-8859-1", text), "a/mark.html": ("utf-8", text), "b/mark16.html": ("utf-16le", text),
        "b/files/named.html": ("latin1", f"<html><meta charset=latin1>{text}"), "plain": ("utf-8", text),
        "broken": ("utf-8", "a�b"), "odd": ("utf-8", text), "cut16": ("utf-16le", "a�"),
    }
    assert got["a/declared.html"].mime == "text/html" and got["plain"].body_length == len(text.encode())


# Rates ---------------------------------------------------------------------


def test_means_are_those_of_a_fold(spark):
    """Rates over several hours, in many tasks and any order, against a fold; the means are cut at each step."""
    rng = random.Random(6)
    rows = [(k, s, rng.choice([0, 1, 3, 10**6, rng.randrange(10**9)])) for k in range(6) for s in sorted(rng.sample(range(40_000), 900 * (k > 0) + 3))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "transfer_id long, s long, rate long").withColumn("second", F.timestamp_seconds("s"))
    got = {r.transfer_id: (r.n, r.avg_rate) for r in average_rates(df.repartition(7)).collect()}
    want = {}
    for k, _, rate in rows:
        if rate > 0:
            n, mean = want.get(k, (0, 0))
            want[k] = n + 1, next_average(mean, rate, n)
    assert got == want


def test_ticks_without_bytes(spark):
    events = spark.createDataFrame([(1, 10, 5), (1, 10, 6), (1, 13, 1), (2, 7000, 4), (2, 14_500, 2)], "transfer_id long, s long, bytes long")
    events = events.withColumn("ts", F.timestamp_micros(F.col("s") * 1_000_000 + 400_000))
    rates = rate_per_second(events, zero_fill=True).selectExpr("transfer_id", "unix_seconds(second) as s", "rate")
    got = {(r.transfer_id, r.s): r.rate for r in rates.collect()}
    assert got == {(1, 10): 11, (1, 11): 0, (1, 12): 0, (1, 13): 1} | {(2, s): {7000: 4, 14_500: 2}.get(s, 0) for s in range(7000, 14_501)}
    hours = rate_per_second(events, zero_fill=True, tick="1 hour").selectExpr("transfer_id", "unix_seconds(second) as s", "rate")
    assert {(r.transfer_id, r.s): r.rate for r in hours.collect()} == {(1, 0): 12, (2, 3600): 4, (2, 7200): 0, (2, 10800): 0, (2, 14400): 2}
