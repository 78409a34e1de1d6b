import random
import time
from collections import Counter, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webframe.operators import crawl, pathset, transfers
from webframe.operators.prefix import running
from webframe.options import MirrorOptions
from webframe.plans import site_mirror, views
from webframe.plans.download import download
from webframe.plans.site_mirror import mirror
from webframe.sources.sinks import write_saved
from webframe.sources.url_list import read_url_list


def bfs(edges, seeds):
    out = {}
    for sid, start in seeds:
        seen, todo = {start: 0}, deque([start])
        while todo:
            u = todo.popleft()
            for v in edges.get(u, ()):
                if v not in seen:
                    seen[v] = seen[u] + 1
                    todo.append(v)
        out.update({(sid, u): d for u, d in seen.items()})
    return out


@pytest.mark.parametrize("buckets", [None, 3])
def test_closure_is_bfs(spark, buckets):
    rng = random.Random(5)
    # One page holds a third of all links, and one target gets a third of them.
    pairs = [("hub", f"p{rng.randrange(400)}") for _ in range(600)]
    pairs += [(f"p{rng.randrange(400)}", "hub") for _ in range(600)]
    pairs += [(f"p{rng.randrange(400)}", f"p{rng.randrange(400)}") for _ in range(500)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(12)]
    seeds = [(1, "p3"), (2, "hub"), (3, "c0"), (4, "nowhere"), (1, "p3")]
    graph = {}
    for a, b in pairs:
        graph.setdefault(a, []).append(b)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = crawl.closure(edges, spark.createDataFrame(seeds, "seed_id bigint, url string"), buckets=buckets)
    rows = got.collect()
    assert {(r.seed_id, r.url): r.depth for r in rows} == bfs(graph, set(seeds))
    assert len(rows) == len({(r.seed_id, r.url) for r in rows})
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("closure")]


def test_closure_moves_only_the_frontier(spark):
    """No exchange above the scan of the graph or of the visited set; the frontier and its targets are dealt."""
    edges = spark.createDataFrame([(f"p{i}", [f"p{i * 7 % 50}", f"p{i + 1}"]) for i in range(50)], "src string, dsts array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        level = crawl.Closure(edges, spark.createDataFrame([(1, "p1"), (2, "p3")], "seed_id bigint, url string"))
        while level.added:
            plan = level.fresh()._jdf.queryExecution().executedPlan().toString().splitlines()
            exchanges = [k for k, line in enumerate(plan) if "Exchange " in line]
            scans = {name: k for k, line in enumerate(plan) for name in ("_graph", "_visited") if "Bucketed: true" in line and name in line}
            assert len(exchanges) == 2 and len(scans) == 2, plan
            # What stands above a line has less indent; an exchange above would be further out on the way up.
            for at in scans.values():
                indent = lambda line: len(line) - len(line.lstrip(" :+-"))
                depth = indent(plan[at])
                above = []
                for line in reversed(plan[:at]):
                    if indent(line) < depth:
                        above.append(line)
                        depth = indent(line)
                joins = [k for k, line in enumerate(above) if "SortMergeJoin" in line]
                assert not any("Exchange " in line for line in above[: joins[0]]), above
            level.step()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert level.depth > 5 and level.reached.count() > 60


def test_closure_of_nested_edges(spark):
    edges = spark.createDataFrame([("a", ["b", "c"]), ("b", ["a"]), ("c", ["d"])], "src string, dsts array<string>")
    seeds = spark.createDataFrame([(1, "a"), (2, "b")], "seed_id bigint, url string")
    got = {(r.seed_id, r.url): r.depth for r in crawl.closure(edges, seeds).collect()}
    assert got == bfs({"a": ["b", "c"], "b": ["a"], "c": ["d"]}, [(1, "a"), (2, "b")])


def test_closure_depth_limit(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(9)], "src string, dst string")
    seeds = spark.createDataFrame([(1, "c0")], "seed_id bigint, url string")
    assert crawl.closure(edges, seeds, max_depth=4).agg(F.max("depth"), F.count("*")).first() == (4, 5)


def test_site_closed_form(spark, sf):
    done = mirror(views.site(spark, sf).withColumn("status", F.lit(200)), views.site_seeds(spark, sf))
    pages = done.results.where("mime = 'text/html' AND error IS NULL").groupBy("seed_id").agg(
        F.count("*").alias("n"), F.max("depth").alias("d")
    )
    hosts = Counter(r.h for r in views.pages(spark, sf).select(views.page_host().alias("h")).collect())
    assert sorted((r.n, r.d) for r in pages.collect()) == sorted((m, m.bit_length() - 1) for m in hosts.values())
    paths = done.files.agg(F.count("*"), F.count_distinct("save_path")).first()
    assert paths[0] == paths[1]


def test_mirror_rejects_traverses_and_converts(spark, tmp_path):
    def page(url, body, mime="text/html", status=200, declared=None, filename=None):
        n = len(body.encode())
        return (url, status, mime, n if declared is None else declared, filename, n, body)

    rows = [
        page("http://h/", "<a href='a'>a</a><a href=/b.html#x>b</a><link href=/s.css><img src=no.png><a href='http://x/y'>"),
        page("http://h/a", "<a href='/a/c'>c</a>"),
        page("http://h/a/c", "<a href='/'>up</a><a href='/skip.html'>"),
        page("http://h/b.html#x", "b"),
        page("http://h/skip.html", "<a href='/deep'>"),
        page("http://h/skip.html/deep", "never linked"),
        page("http://h/deep", "deep"),
        page("http://h/s.css", "a{b:url(i.png)} c{d:url('/j.gif')}", "text/css"),
        page("http://h/s.css/i.png", "png", "image/png"),
        page("http://h/j.gif", "gif", "image/gif", declared=99),
        page("http://h/lost", "x"),
    ]
    schema = "url string, status int, mime string, declared_length bigint, filename string, body_length bigint, body string"
    snapshot = spark.createDataFrame(rows, schema)
    seeds = spark.createDataFrame([(1, "http://h/")], "seed_id bigint, url string")
    done = mirror(snapshot, seeds, MirrorOptions(rejects=("skip*",), save_path="m"))
    results = {r.url: (r.error, r.keep) for r in done.results.collect()}
    assert results == {
        "http://h/": (None, True), "http://h/a": (None, True), "http://h/a/c": (None, True),
        "http://h/b.html#x": (None, True), "http://h/skip.html": (None, False), "http://h/deep": (None, True),
        "http://h/s.css": (None, True), "http://h/s.css/i.png": (None, True),
        "http://h/j.gif": ("short_body", True), "http://h/no.png": ("not_found", None),
    }
    files = {r.save_path: r.url for r in done.files.collect()}
    assert files == {
        "m/h/index.html": "http://h/", "m/h/a/index.html": "http://h/a", "m/h/a/c": "http://h/a/c",
        "m/h/b.html": "http://h/b.html#x", "m/h/deep": "http://h/deep", "m/h/s.css/index.html": "http://h/s.css",
        "m/h/s.css/i.png": "http://h/s.css/i.png",
    }
    bodies = {r.save_path: r.body for r in done.converted().collect()}
    assert bodies["m/h/index.html"] == (
        "<a href='a/index.html'>a</a><a href=\"b.html\">b</a><link href=\"s.css/index.html\"><img src=no.png><a href='http://x/y'>"
    )
    assert bodies["m/h/a/c"] == "<a href='../index.html'>up</a><a href='/skip.html'>"
    assert bodies["m/h/s.css/index.html"] == "a{b:url(i.png)} c{d:url('/j.gif')}"
    outcomes = {
        r.outcome: r.n_links
        for r in crawl.link_outcomes(
            done.reached, done.nested, done.results.where("keep IS NOT NULL").select("url", "error", "keep")
        ).collect()
    }
    assert outcomes == {"saved": 6, "not_found": 1, "off_host": 1, "visited": 1, "rejected": 1, "short_body": 1}
    kept = done.manifest().withColumn("host", F.lit("h"))
    write_saved(kept, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    bad = kept.limit(1).withColumn("save_path", F.lit("../../x"))
    refused = write_saved(bad, str(tmp_path / "bad"), None)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 0 and refused.count() == 1
    site = done.saved_site().collect()
    assert {r.save_path for r in site} == {r.save_path for r in done.files.select("save_path").collect()} and all(r.body is not None for r in site)


def name(base, k):
    if k == 0:
        return base
    i = base.rfind(".", base.rfind("/") + 1)
    return f"{base}({k})" if i < 0 else f"{base[:i]}({k}){base[i:]}"


def one_by_one(names, existing):
    taken, out = set(existing), []
    for n in names:
        if not n.strip():
            out.append("")
            continue
        k = 0
        while name(n, k) in taken:
            k += 1
        taken.add(name(n, k))
        out.append(name(n, k))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_unique_names_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = ["a.txt", "a.txt", "a.txt", "a.txt", "a(1).txt", "a(2).txt", "b", "b(1)", "", "a(1)(1).txt", ".zip", "c.tar.gz"]
    names = [rng.choice(pool) for _ in range(60)]
    existing = ["a.txt", "a(3).txt", "b(2)", "c.tar.gz", "c.tar(1).gz", "c.tar(2).gz"]
    df = spark.createDataFrame(list(enumerate(names)), "ordinal bigint, name string")
    for old in ([], existing):
        have = spark.createDataFrame([(e,) for e in old], "name string") if old else None
        got = pathset.unique_names(df, have, bucket_size=7).orderBy("ordinal").collect()
        assert [r.unique_name for r in got] == one_by_one(names, old)


def test_dir_conflicts(spark):
    rows = [("h/app",), ("h/app/a.css",), ("h/b",), ("h/bc/d",)]
    got = pathset.resolve_dir_conflicts(spark.createDataFrame(rows, "save_path string"))
    assert sorted(r[0] for r in got.collect()) == ["h/app/a.css", "h/app/index.html", "h/b", "h/bc/d"]


def test_last_write_wins(spark):
    rows = [("u1", "f", 1), ("u2", "f", 3), ("u3", "f", 2), ("u4", "g", 1)]
    got = pathset.last_write_wins(spark.createDataFrame(rows, "url string, save_path string, o int"), "o")
    assert sorted(map(tuple, got.collect())) == [("f", "u2", 3), ("g", "u4", 1)]


@pytest.mark.parametrize(("how", "fold"), [("sum", lambda a, b: a + b), ("max", max)])
def test_running(spark, how, fold):
    rng = random.Random(3)
    # One key holds a third of the rows, and a key may be NULL.
    rows = [(rng.choice(["hot", "hot", "a", "b", "c", None]), i, rng.randrange(-9, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = running(df, ["k"], ["o"], F.col("v"), "r", F.floor(F.col("o") / 10), how)
    state, want = {}, {}
    for k, o, v in rows:
        state[k] = fold(state[k], v) if k in state else v
        want[o] = state[k]
    assert {r.o: r.r for r in got.collect()} == want


def ticks(rows):
    start = datetime(2024, 1, 1)
    return [(t, start + timedelta(seconds=s), i, b, k) for i, (t, s, b, k) in enumerate(rows)]


TRANSFERS = "transfer_id bigint, ts timestamp, event_id bigint, bytes bigint, kind string"


def test_rates_and_averages(spark):
    rows = ticks([(1, 0.1, 4, "p"), (1, 0.9, 6, "p"), (1, 1.5, 5, "p"), (1, 4.0, 8, "f"), (2, 3599.5, 1, "p"), (2, 3601.0, 0, "error")])
    df = spark.createDataFrame(rows, TRANSFERS)
    rates = transfers.rate_per_second(df, zero_fill=True)
    got = {(r.transfer_id, r.second.minute * 60 + r.second.second): r.rate for r in rates.collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0): 10, (1, 1): 5, (1, 2): 0, (1, 3): 0, (1, 4): 8}
    assert len([k for k in got if k[0] == 2]) == 3
    averages = transfers.average_rates(rates)
    assert {r.transfer_id: (r.n, r.avg_rate) for r in averages.collect()} == {1: (3, 7), 2: (1, 1)}
    def status(*totals):
        known = spark.createDataFrame(totals, "transfer_id bigint, total bigint")
        return {r.transfer_id: tuple(r)[1:] for r in transfers.final_status(df, averages, known).collect()}

    assert status((1, 50), (2, 9)) == {1: (False, 23, 50, 3, 7), 2: (True, 1, 9, 1, 1)}
    assert status((1, -1)) == {1: (False, 23, 23, 3, 7), 2: (True, 1, -1, 1, 1)}


def test_average_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(1)
        rows = [(i % 3, datetime(2024, 1, 1) + timedelta(seconds=i), rng.randrange(0, 50)) for i in range(300)]
        got = transfers.average_rates(spark.createDataFrame(rows, "transfer_id bigint, second timestamp, rate bigint")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for t, _, r in rows:
        if r > 0:
            n, a = want.get(t, (0, 0))
            want[t] = (n + 1, (a * n + r) // (n + 1))
    assert {r.transfer_id: (r.n, r.avg_rate) for r in got} == want


def test_throttle(spark):
    df = spark.createDataFrame(ticks([(1, 0, 3, "p"), (1, 1, 2, "p"), (1, 2, 1, "p"), (1, 3, 9, "p")]), TRANSFERS)
    assert [r.done_second for r in transfers.throttle_schedule(df, 5).orderBy("event_id").collect()] == [0, 0, 1, 2]
    assert [r.done_second for r in transfers.throttle_schedule(df, 0).orderBy("event_id").collect()] == [0, 0, 0, 0]


def test_url_list(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("  example.com \nexample.com\n\nhttps://a.b/c\n")
    rows = read_url_list(spark, str(path), "PERMISSIVE").collect()
    assert [(r.url, r._error) for r in rows] == [
        ("https://example.com", None), ("https://example.com", None), (None, "host missing"), ("https://a.b/c", None),
    ]
    assert read_url_list(spark, str(path), "DROPMALFORMED").count() == 3
    with pytest.raises(Exception, match="host missing"):
        read_url_list(spark, str(path)).collect()
    with pytest.raises(ValueError):
        read_url_list(spark, str(path), "x")


def test_download_keeps_duplicates(spark):
    seeds = spark.createDataFrame([(0, "http://h/a.txt"), (1, "http://h/a.txt"), (2, "http://h/gone")], "ordinal bigint, url string")
    snapshot = spark.createDataFrame([("http://h/a.txt", 200, -1, 5)], "url string, status int, declared_length bigint, body_length bigint")
    got = download(seeds, snapshot, MirrorOptions(mirror=False, save_path="d")).orderBy("ordinal").collect()
    assert [(r.save_path, r.error) for r in got] == [("d/a.txt", None), ("d/a(1).txt", None), ("d/gone", "not_found")]


def test_streams_over_unordered_part_files(spark, sf, tmp_path):
    """Any number of files in a table folder gives the rows of the one file, every byte included."""
    from webframe.plans.queries import QUERIES

    for name in ("pages", "events"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        df.repartition(4, F.xxhash64(df.columns[0])).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_links", "stream_rate", "stream_admission"):
        whole, parts = QUERIES[name](spark, sf), QUERIES[name](spark, str(tmp_path))
        assert sorted(whole.collect()) == sorted(parts.collect()) != []
    total = spark.read.parquet(f"{sf}/events.parquet").agg(F.sum(F.round(F.col("value") * 100).cast("bigint"))).first()[0]
    assert QUERIES["stream_rate"](spark, str(tmp_path)).agg(F.sum("rate")).first()[0] == total


def test_late_rows_are_an_error(spark, tmp_path):
    from webframe.streaming.rates import stream_rate
    from webframe.streaming.runs import LateRows, admit, run_available

    for k, second in enumerate(("2024-01-01 00:10:00", "2024-01-01 00:20:00", "2024-01-01 00:00:00")):
        row = spark.sql(f"select 1L as transfer_id, timestamp'{second}' as ts, 5L as bytes").coalesce(1)
        row.write.mode("append").parquet(str(tmp_path / "t"))
        time.sleep(1.1)
    stream = admit(spark, str(tmp_path / "t"), row.schema, max_files=1)
    with pytest.raises(LateRows):
        run_available(stream_rate(stream), "late")


def test_mirror_judges_responses_once(spark, sf, monkeypatch):
    """Results come out of the pass that reads the links, and both versions of a saved site out of one crawl."""
    from webframe.plans.queries import QUERIES

    done, judged = [], site_mirror.fetch_results
    monkeypatch.setattr(site_mirror, "fetch_results", lambda *a, **kw: done.append("judged") or judged(*a, **kw))
    crawled = site_mirror.closure
    monkeypatch.setattr(site_mirror, "closure", lambda *a, **kw: done.append("crawled") or crawled(*a, **kw))
    assert QUERIES["saved_site"](spark, sf).where("body_md5 IS NULL").isEmpty()
    assert sorted(done) == ["crawled", "judged"]
