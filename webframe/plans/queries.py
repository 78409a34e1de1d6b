"""Registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions import headers as H
from webframe.functions import paths as P
from webframe.functions import sizes as Z
from webframe.functions import urls as U
from webframe.functions.common import record, with_once
from webframe.functions.css import css_url_tokens, css_urls, rewrite_css
from webframe.functions.globs import compile_glob, should_exclude, should_reject
from webframe.functions.html import html_links, rewrite_html
from webframe.operators import crawl, extract, filters, pathset, rewrite
from webframe.operators import transfers as T
from webframe.options import MirrorOptions
from webframe.plans import views as V
from webframe.plans.download import download
from webframe.plans.site_mirror import mirror
from webframe.sources.bodies import read_bodies
from webframe.sources.responses import fetch_join
from webframe.sources.sinks import success_list
from webframe.sources.snapshots import follow_redirects, latest_responses
from webframe.sources.staging import Workspace
from webframe.sources.url_list import mirror_seeds, read_url_list, seed_union
from webframe.sources.versions import Site
from webframe.streaming.links import first_sightings, stream_links
from webframe.streaming.rates import stream_rate
from webframe.streaming.runs import ROCKSDB, Run, admit, last_updates, run_available
from webframe.streaming.transfers import last_states, transfer_states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Registers a query under the name of its function."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    QUERIES[fn.__name__.removesuffix("_query")] = run
    return fn


def _big(col, name):
    return col.cast("bigint").alias(name)


# URLs ----------------------------------------------------------------------


@query
def url_parts(spark, sf):
    return (
        V.pages(spark, sf)
        .select("page_id", U.parse_url("url").alias("p"))
        .select("page_id", "p.scheme", "p.host", "p.path", "p.query", "p.fragment", "p.error")
    )


def _seed_forms(spark, sf):
    host = F.col("h")
    return V.variants(
        V.pages(spark, sf).select("page_id", "url", V.page_host().alias("h")),
        [
            F.col("url"), host, V.text(host, ":80"), V.text(host, ":443"), V.text("/", host), V.text("ftp://", host),
            F.split_part(host, F.lit("."), F.lit(1)), V.text("https://-", host), V.text("a b", host),
            V.text("localhost:", F.col("page_id")), F.lit("https://"), V.text(host, ":8080/x?y"),
        ],
        "raw",
    )


@query
def validate_urls(spark, sf):
    return (
        _seed_forms(spark, sf)
        .select("page_id", "variant", "raw", U.validate_url("raw").alias("v"))
        .select("page_id", "variant", "raw", "v.url", "v.valid", "v.error")
    )


@query
def clean_slash(spark, sf):
    doubled = F.replace(F.replace(F.col("url"), F.lit("/"), F.lit("//")), F.lit("e"), F.lit("e///"))
    return V.pages(spark, sf).select("page_id", P.clean_slash(doubled).alias("cleaned"))


def _url_forms(spark, sf):
    host = F.col("h")
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    rooted = F.get(F.filter(V.own_links(), lambda x: x.startswith("/")), F.lit(0))
    word = F.coalesce(F.substring(rooted, 2, 1 << 20), F.lit(""))
    return V.variants(
        V.linked_pages(spark, sf).select("page_id", "url", V.page_host().alias("h"), word.alias("w"), path.alias("p")),
        [
            F.col("url"), V.text("http:///", host, F.col("p")), V.text("HTTPS://", host, "//a//", F.col("w"), "/"),
            V.text("http://", host, "/a b/", F.col("w")), V.text("mailto:", F.col("w"), "@", host),
            V.text("http://", host, ":x", F.col("p")), V.text("..///", F.col("w"), "//"), V.text("/", F.col("w"), "?q=a//b c#f"),
        ],
        "raw",
    )


@query
def clean_url(spark, sf):
    return _url_forms(spark, sf).select("page_id", "variant", U.clean_url("raw").alias("cleaned"))


def _link_forms(spark, sf):
    """The page's own links, and a set of made-up forms per page."""
    i, host = F.col("page_id"), F.col("h")
    forms = F.array(
        F.lit("../x"), F.lit("./y/../z"), F.lit("?q=1"), F.lit("#frag"), F.lit(""), F.lit("../../../../up"),
        V.text("//", host, "//cdn//", i), V.text("mailto:a@", host), F.lit("javascript:void(0)"),
        V.text("b", i, ".html"), V.text("http://", host, "/abs/", i), F.lit("."), F.lit("a:b"), F.lit("/p/./q/../r/"),
    )
    with_host = V.linked_pages(spark, sf).withColumn("h", V.page_host())
    return with_host.select("page_id", "url", F.concat(V.own_links(), forms).alias("links"))


def _resolved_forms(spark, sf):
    based = _link_forms(spark, sf).select("page_id", "url", "links", U.base_of("url").alias("base"))
    resolved = F.transform("links", lambda x: record(link=x, dst=U.resolve_with(F.col("base"), x)))
    return based.select("page_id", "url", F.posexplode(resolved).alias("pos", "_l")).select(
        "page_id", "url", F.col("pos").cast("bigint"), "_l.link", "_l.dst"
    )


@query
def resolve_links(spark, sf):
    return _resolved_forms(spark, sf).select("page_id", "pos", "link", "dst")


@query
def same_host(spark, sf):
    resolved = _resolved_forms(spark, sf)
    return resolved.select("page_id", "pos", U.same_host("url", F.coalesce("dst", "link")).alias("same"))


@query
def seed_default_scheme(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    forms = V.variants(V.pages(spark, sf).select("page_id", "url"), [F.col("url"), bare, V.text("//", bare), V.text("1:", bare)], "raw")
    return forms.select("page_id", "variant", "raw").transform(
        lambda d: mirror_seeds(d.withColumn("url", F.col("raw")))
    )


@query
def unresolvable_links(spark, sf):
    _, lost = extract.split_unresolvable(_resolved_forms(spark, sf))
    return lost.groupBy("link").agg(F.count(F.lit(1)).alias("n"))


# Headers -------------------------------------------------------------------


@query
def header_get(spark, sf):
    return V.responses(spark, sf).select(
        "page_id",
        H.header_get("headers", "content-type").alias("content_type"),
        H.header_get("headers", "Content-Disposition").alias("disposition"),
        H.header_get("headers", "x-none").alias("absent"),
    )


@query
def mime_type(spark, sf):
    return V.responses(spark, sf).select("page_id", "mime")


@query
def content_length(spark, sf):
    return V.responses(spark, sf).select("page_id", "declared_length")


@query
def disposition_filename(spark, sf):
    return V.responses(spark, sf).select("page_id", "filename")


@query
def mime_extension(spark, sf):
    return V.responses(spark, sf).select("page_id", H.mime_extension("mime").alias("extension"))


# Extraction ----------------------------------------------------------------


@query
def html_links_query(spark, sf):
    return extract.extract_links(V.decorated(spark, sf), keep=["page_id"])



@query
def attr_links(spark, sf):
    links = extract.extract_links(V.pages(spark, sf), keep=["page_id"])
    return links.where("kind = 'attr'").select("page_id", "pos", "tag", "link")


@query
def style_links(spark, sf):
    links = extract.extract_links(V.decorated(spark, sf), keep=["page_id"])
    return links.where("kind = 'style_element'").select("page_id", "pos", "link")


@query
def style_attr_links(spark, sf):
    links = extract.extract_links(V.decorated(spark, sf), keep=["page_id"])
    return links.where("kind = 'style_attr'").select("page_id", "tag", "link")


@query
def css_urls_query(spark, sf):
    return extract.extract_css_links(V.sheets(spark, sf), keep=["page_id"]).select("page_id", "pos", "link")



@query
def css_url_tokens_query(spark, sf):
    tokens = F.posexplode(css_url_tokens("css")).alias("pos", "token")
    return V.sheets(spark, sf).select("page_id", tokens).withColumn("pos", F.col("pos").cast("bigint"))



# Rewriting -----------------------------------------------------------------


@query
def rewrite_css_query(spark, sf):
    new = rewrite_css("css", lambda u: F.concat(F.lit("/m"), u))
    return V.sheets(spark, sf).select("page_id", new.alias("css"))



@query
def rewrite_html_query(spark, sf):
    new = rewrite_html("html", lambda u, is_a: F.when(is_a, F.concat(F.lit("/m"), u)).otherwise(u))
    return V.decorated(spark, sf).select("page_id", new.alias("html"))



@query
def relative_path(spark, sf):
    links = _resolved_forms(spark, sf).where("dst IS NOT NULL")
    none = F.lit(None).cast("string")
    here = pathset.save_path("url", F.lit("text/html"), none)
    there = pathset.save_path("dst", F.lit("text/html"), none)
    return links.select("page_id", "pos", P.relative_path(here, there).alias("relative"))


def _site_mirror(spark, sf, **options):
    return mirror(V.site(spark, sf), V.site_seeds(spark, sf), MirrorOptions(**options))


@query
def convert_links_html(spark, sf):
    done = _site_mirror(spark, sf, convert_links=True).converted()
    return done.where(F.col("url").rlike("/p/[0-9]+$")).select("url", "save_path", F.md5("body").alias("body_md5"))


@query
def convert_links_css(spark, sf):
    done = _site_mirror(spark, sf, convert_links=True).converted()
    return done.where(F.col("url").endswith(".css")).select("url", "save_path", "body")


# Filters -------------------------------------------------------------------

REJECTS = ("*ion", "th?r", "en", ".html")
EXCLUDES = ("/en", "/f*")


@query
def glob_compile(spark, sf):
    """How many page paths each compiled glob matches, with its expression."""
    rows = [(p, r) for p in REJECTS + EXCLUDES + ("[0-4]*", "") for r in (True, False)]
    path = U.url_path("url")
    counts = []
    for i, (pattern, is_reject) in enumerate(rows):
        hit = should_reject("path", [pattern]) if is_reject else should_exclude("path", [pattern])
        counts.append(F.count_if(hit).alias(f"c{i}"))
    totals = V.pages(spark, sf).select(path.alias("path")).agg(*counts)
    entries = F.array(
        *[
            F.struct(
                F.lit(p).alias("pattern"),
                F.lit(r).alias("is_reject"),
                F.lit(compile_glob(p, r)).alias("regex"),
                F.col(f"c{i}").alias("n_matches"),
            )
            for i, (p, r) in enumerate(rows)
        ]
    )
    return totals.select(F.inline(entries))


def _paths(spark, sf):
    resolved = _resolved_forms(spark, sf).where("dst IS NOT NULL")
    return with_once(resolved, path=U.url_path("dst")).select("page_id", "pos", "dst", "path")


@query
def reject_filter(spark, sf):
    return _paths(spark, sf).where(should_reject("path", REJECTS)).select("page_id", "pos", "dst")


@query
def exclude_filter(spark, sf):
    return _paths(spark, sf).where(should_exclude("path", EXCLUDES)).select("page_id", "pos", "dst")


@query
def should_download(spark, sf):
    limited = filters.with_limits(V.responses(spark, sf).drop("body"), REJECTS, EXCLUDES)
    return limited.select("page_id", "wanted", "traverse", "keep")


@query
def status_filter(spark, sf):
    return V.responses(spark, sf).where(filters.allowed_status("status", (200,))).select("page_id", "url")


@query
def same_host_edges(spark, sf):
    links = extract.resolve_links(V.site_pages(spark, sf))
    return extract.same_host_links(links).select("src", "pos", "dst")


@query
def mime_dispatch(spark, sf):
    return V.responses(spark, sf).select("page_id", filters.mime_class("mime").alias("branch"))


# Crawl ---------------------------------------------------------------------


def _candidates(spark, sf):
    return _resolved_forms(spark, sf).where("dst IS NOT NULL").select(
        "page_id", (F.col("page_id") % 5).alias("seed_id"), F.col("dst").alias("url")
    )


@query
def frontier_dedup(spark, sf):
    both = _candidates(spark, sf)
    return crawl.unseen(both.where("page_id % 3 != 0"), both.where("page_id % 3 = 0"))


@query
def fetch_join_query(spark, sf):
    links = extract.same_host_links(extract.resolve_links(V.site_pages(spark, sf)))
    frontier = links.select(F.col("dst").alias("url")).distinct()
    site = V.site(spark, sf).select("url", "status", "mime", "declared_length", "body_length")
    return fetch_join(frontier, site).select("url", _big(F.col("status"), "status"), "error")



@query
def mirror_closure(spark, sf):
    return _site_mirror(spark, sf).reached.select("seed_id", "url", "depth")


@query
def mirror_depth(spark, sf):
    reached = _site_mirror(spark, sf).reached
    return reached.groupBy("depth").agg(F.count(F.lit(1)).alias("n_urls"))


@query
def multi_seed_mirror(spark, sf):
    """Each host from its first page and from its second, as two seeds."""
    seeds = V.site_seeds(spark, sf)
    second = seeds.select((F.col("seed_id") * 2 + 1).alias("seed_id"), F.regexp_replace("url", "/p/1$", "/p/2").alias("url"))
    seeds = seeds.withColumn("seed_id", F.col("seed_id") * 2)
    done = mirror(V.site(spark, sf), seeds.unionByName(second))
    ok = F.count_if(F.col("error").isNull())
    return done.results.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_requested"), ok.alias("n_ok"), F.max("depth").alias("max_depth"))


@query
def link_status(spark, sf):
    done = _site_mirror(spark, sf)
    results = done.results.select("url", _big(F.col("status"), "status"), "error")
    links = extract.same_host_links(done.links).select("src", "pos", "dst")
    return crawl.link_status(links, results).select("src", "pos", "dst", "status", "error")


@query
def discovery_parent(spark, sf):
    done = _site_mirror(spark, sf)
    return crawl.discovery_parents(done.reached, done.nested)


SITE_REJECTS = ("*5", "*.png")


@query
def kept_pages(spark, sf):
    return _site_mirror(spark, sf, rejects=SITE_REJECTS).results.where("error IS NULL AND keep").select("seed_id", "url", "mime")


@query
def links_per_page(spark, sf):
    per_page = extract.links_per_page(extract.page_links(V.pages(spark, sf)))
    return per_page.select("src", "n_links", "n_distinct", F.array_join("links", " ").alias("links"))


@query
def link_outcomes(spark, sf):
    done = _site_mirror(spark, sf, rejects=SITE_REJECTS)
    results = done.results.where("keep IS NOT NULL").select("url", "error", "keep").distinct()
    return crawl.link_outcomes(done.reached, done.nested, results)


@query
def dangling_links(spark, sf):
    """Links to pages that were followed and not kept, of which there is no file."""
    return _site_mirror(spark, sf, rejects=SITE_REJECTS).dangling_links()


@query
def mirror_schedule(spark, sf):
    """When each request is through at 50,000 bytes a second."""
    return _site_mirror(spark, sf, rate_limit=50_000).schedule()


@query
def mirror_manifest(spark, sf):
    done = _site_mirror(spark, sf, save_path="/mirror").manifest()
    return done.select("url", "save_path", _big(F.col("status"), "status"), "mime", "escapes_root")


@query
def saved_site(spark, sf):
    """The files of the site as it was fetched, replaced by the version with converted links."""
    site = Site(spark, Workspace(spark, "saved-site").path)
    done = _site_mirror(spark, sf, convert_links=True)
    site.publish(done.saved_site(convert_links=False))
    site.publish(done.saved_site())
    return site.read().select("save_path", "url", F.md5("body").alias("body_md5"))


# Snapshots -----------------------------------------------------------------


@query
def latest_responses_query(spark, sf):
    """Three crawls, of which the later ones fetched some pages again."""
    crawls = F.filter(F.array(F.lit(0), F.when(F.col("page_id") % 3 == 0, 1), F.when(F.col("page_id") % 4 == 1, 2)), lambda c: c.isNotNull())
    again = V.responses(spark, sf).select("url", "page_id", "status", F.explode(crawls).alias("crawl"), "body")
    body = F.concat(F.lit("<!-- "), F.col("crawl"), F.lit(" -->"), F.col("body"))
    found = latest_responses(again.withColumn("body", body), "crawl", "page_id")
    return found.select("url", _big(F.col("crawl"), "crawl"), "page_id", F.md5("body").alias("body_md5"))


@query
def redirects(spark, sf):
    return follow_redirects(V.redirect_hops(spark, sf)).select("url", "final_url", "n_hops", "error")


@query
def binary_scan(spark, sf):
    """Pages of each host written as one file and read back as a raw body, its charset declared, unknown, or not told."""
    space, pages = Workspace(spark, "bodies"), V.pages(spark, sf).select("page_id", V.page_host().alias("host"), "html")
    dealt = pages.repartition("host").sortWithinPartitions("host", "page_id")
    dealt.select("host", F.col("html").alias("value")).write.partitionBy("host").text(f"{space.path}/files")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{space.path}/files").select("path")
    below = F.substring_index("path", "/files/", -1)
    host = F.url_decode(F.regexp_extract(below, "host=([^/]*)/", 1))
    kind = F.pmod(F.length(host) + F.ascii(host), F.lit(3))
    declared = F.when(kind == 0, "text/html; charset=UTF-8").when(kind == 1, 'text/html;charset="x-own"').otherwise("text/html")
    sidecar = files.select(
        below.alias("path"), F.concat(F.lit("http://"), host, F.lit("/")).alias("url"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.array(declared)).alias("headers"),
    )
    bodies = read_bodies(spark, f"{space.path}/files", sidecar)
    return bodies.select("url", "mime", "charset", "body_length", F.md5("body").alias("body_md5"))


# Seeds and downloads -------------------------------------------------------


def _raw_seeds(spark, sf):
    forms = _seed_forms(spark, sf)
    return forms.where("variant < 6").select("raw"), forms.where("variant >= 6").select("raw")


@query
def seed_union_query(spark, sf):
    good, bad = seed_union(*_raw_seeds(spark, sf))
    rows = good.select("raw", "url", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("raw", F.lit(None).cast("string").alias("url"), F.col("_error").alias("error"))
    )
    return rows.groupBy("raw", "url", "error").agg(F.count(F.lit(1)).alias("n"))



@query
def url_list_scan(spark, sf):
    """Seed forms written as a text file, one per line, and read back."""
    space = Workspace(spark, "url-list")
    _seed_forms(spark, sf).select(V.text("  ", F.col("raw"), " ").alias("value")).write.text(f"{space.path}/list")
    scanned = read_url_list(spark, f"{space.path}/list", "PERMISSIVE")
    return scanned.groupBy("url", F.col("_error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


def _downloads(spark, sf):
    """Every page once, every third page a second time, and unknown pages."""
    i = F.col("page_id")
    again = F.when(i % 3 == 0, F.col("url")).when(i % 10 == 1, V.text(F.col("url"), "/none"))
    seeds = V.pages(spark, sf).select(
        F.inline(
            F.filter(
                F.array(
                    F.struct((i * 2).alias("ordinal"), F.col("url").alias("url")),
                    F.struct((i * 2 + 1).alias("ordinal"), again.alias("url")),
                ),
                lambda x: x["url"].isNotNull(),
            )
        )
    )
    return download(seeds, V.responses(spark, sf), MirrorOptions(mirror=False, save_path="/d"))


@query
def success_list_query(spark, sf):
    return success_list(_downloads(spark, sf)).groupBy("url").agg(F.count(F.lit(1)).alias("n"))



@query
def download_outcomes(spark, sf):
    return T.outcomes(_downloads(spark, sf))


# Paths ---------------------------------------------------------------------


@query
def save_path(spark, sf):
    path = pathset.save_path("url", "mime", "filename", "/mirror")
    return V.responses(spark, sf).select("page_id", path.alias("save_path"))


@query
def output_path(spark, sf):
    return V.pages(spark, sf).select("page_id", P.output_path("url").alias("name"), P.output_path("url", "/d").alias("path"))


@query
def unique_names(spark, sf):
    names = _resolved_forms(spark, sf).where("dst IS NOT NULL").select(
        F.struct("page_id", "pos").alias("at"), P.output_path("dst").alias("name")
    )
    numbered = pathset.numbered(names, "at", "ordinal")
    return pathset.unique_names(numbered).select("at.page_id", "at.pos", "name", "unique_name")


def _saved(spark, sf):
    """Save paths of all resolved links and of their parent pages."""
    links = _resolved_forms(spark, sf).where("dst IS NOT NULL")
    none = F.lit(None).cast("string")
    return links.select("page_id", "pos", F.col("dst").alias("url"), pathset.save_path("dst", F.lit("text/html"), none).alias("save_path"))


@query
def path_ancestors(spark, sf):
    dirs = _saved(spark, sf).select(F.explode(P.ancestors("save_path")).alias("dir"))
    return dirs.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))


@query
def clean_path(spark, sf):
    messy = V.text(F.col("path"), "/./x/../", F.col("pos"), "//..")
    climbing = V.text("../a/../..", F.col("path"))
    return _paths(spark, sf).select(
        "page_id", "pos", P.clean_path(messy).alias("rooted"), P.clean_path(climbing).alias("relative"),
        P.dir_name("path").alias("dir"), P.base_name("path").alias("base"),
    )


@query
def path_collisions(spark, sf):
    files = _saved(spark, sf).select("url", "save_path", F.struct("page_id", "pos").alias("fetch_order"))
    return pathset.last_write_wins(files, "fetch_order").where("n_urls > 1")


@query
def dir_conflicts(spark, sf):
    files = _saved(spark, sf).select(F.col("save_path").alias("raw_path")).distinct()
    return pathset.resolve_dir_conflicts(files.withColumn("save_path", F.col("raw_path")))


# Transfers and sizes -------------------------------------------------------


@query
def mirror_summary(spark, sf):
    """Over every request of the mirror; each level takes a minute, as the snapshot knows no times."""
    taken = F.when(F.col("error").isNull(), F.col("body_length")).otherwise(0)
    at = F.timestamp_seconds(F.col("depth") * 60)
    return T.mirror_summary(_site_mirror(spark, sf).results.select(at.alias("ts"), taken.alias("bytes")))


@query
def running_bytes(spark, sf):
    return T.running_bytes(V.transfers(spark, sf)).select("transfer_id", "event_id", "downloaded")


def _progress(spark, sf):
    t = V.transfers(spark, sf)
    totals = t.groupBy("transfer_id").agg(F.sum("bytes").alias("total"))
    # Every seventh transfer has an unknown length.
    total = F.when(F.col("transfer_id") % 7 == 0, -1).otherwise(F.col("total"))
    return T.running_bytes(t).join(totals, "transfer_id").withColumn("total", total)


@query
def percent_complete(spark, sf):
    return _progress(spark, sf).select("event_id", Z.percent_complete("downloaded", "total").alias("percent"))


@query
def eta(spark, sf):
    rate = F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.greatest(F.floor(F.col("bytes") / 1000), F.lit(1)))
    return _progress(spark, sf).select("event_id", Z.eta("downloaded", "total", rate).alias("eta"))


@query
def rate_per_second(spark, sf):
    rates = T.rate_per_second(V.transfers(spark, sf))
    return rates.select("transfer_id", Z.format_time("second").alias("second"), "rate")


@query
def rate_ticks(spark, sf):
    """Bytes in each hour of a transfer, those without bytes included."""
    rates = T.rate_per_second(V.transfers(spark, sf), zero_fill=True, tick="1 hour")
    return rates.select("transfer_id", Z.format_time("second").alias("hour"), "rate")


@query
def avg_rate(spark, sf):
    return T.average_rates(T.rate_per_second(V.transfers(spark, sf)))


@query
def final_status(spark, sf):
    """Every seventh transfer has an unknown length."""
    t = V.transfers(spark, sf)
    total = F.when(F.col("transfer_id") % 7 == 0, -1).otherwise(F.col("transfer_id") * 1000)
    totals = t.select("transfer_id").distinct().withColumn("total", total)
    return T.final_status(t, T.average_rates(T.rate_per_second(t)), totals)


@query
def throttle_schedule(spark, sf):
    return T.throttle_schedule(V.transfers(spark, sf), 5_000).select("event_id", "done_second")


@query
def length_check(spark, sf):
    return V.responses(spark, sf).select("page_id", T.body_check(F.col("body"), F.col("declared_length")).alias("check"))


@query
def content_hash(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("sha256"))


@query
def parse_rate(spark, sf):
    i = F.col("l_orderkey") + F.col("l_linenumber")
    unit = F.when(i % 5 == 0, "k").when(i % 5 == 1, "M").when(i % 5 == 2, "KB").when(i % 5 == 3, " ").otherwise("")
    rate = V.text(F.col("l_quantity").cast("int"), ".", i % 100, unit)
    return V.table(spark, sf, "lineitem").select("l_orderkey", _big(F.col("l_linenumber"), "l_linenumber"), Z.parse_rate(rate).alias("rate"))


def _sized(spark, sf):
    i = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    n = F.floor(F.col("l_extendedprice") * F.when(i % 4 == 0, 0.01).when(i % 4 == 1, 1).when(i % 4 == 2, 300).otherwise(90000))
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", _big(F.col("l_linenumber"), "l_linenumber"), F.when(i % 50 == 0, -1).otherwise(n.cast("bigint")).alias("n")
    )


@query
def format_size(spark, sf):
    return _sized(spark, sf).select("l_orderkey", "l_linenumber", Z.format_size("n").alias("size"))


@query
def round_bytes(spark, sf):
    return _sized(spark, sf).select("l_orderkey", "l_linenumber", Z.round_bytes("n").alias("size"))


@query
def format_time(spark, sf):
    t = V.transfers(spark, sf)
    seconds = F.unix_seconds("ts") % 100_000
    return t.select("event_id", Z.format_time("ts").alias("at"), Z.format_duration(seconds).alias("since"))


@query
def status_report(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("start", "status", "length", "file", "finished")])
    i = F.col("page_id")
    at = F.timestamp_seconds(i * 37 + 1_700_000_000)
    code = F.when(F.col("status") == 200, "200 OK").otherwise("404 Not Found")
    url = F.when(F.col("status") == 200, F.col("url")).otherwise("")
    path = pathset.save_path("url", "mime", "filename")
    rows = V.responses(spark, sf).select(
        "page_id", "declared_length", at.alias("at"), code.alias("code"), url.alias("url"), path.alias("path"), F.explode(kinds).alias("kind")
    )
    line = Z.status_lines(F.col("kind"), F.col("at"), F.col("code"), F.col("declared_length"), F.col("path"), F.col("url"))
    return rows.select("page_id", "kind", line.alias("line"))


# Streams -------------------------------------------------------------------


def _page_stream(spark, sf, **limits):
    return admit(spark, f"{sf}/pages.parquet", V.pages(spark, sf).schema, **limits)


def _event_stream(spark, sf):
    t = admit(spark, f"{sf}/events.parquet", V.table(spark, sf, "events").schema)
    return t.select(
        F.col("user_id").alias("transfer_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"), F.col("event_type").alias("kind"),
    )


@query
def stream_links_query(spark, sf):
    links = stream_links(_page_stream(spark, sf))
    return run_available(links, "stream-links").select("src", "pos", "link", "dst")



@query
def stream_visited(spark, sf):
    """First sightings of URLs; the run is stopped after its first batch and goes on from what it has written."""
    space, run = Workspace(spark, "arrivals"), Run("stream-visited", store=ROCKSDB)
    pages, files = V.pages(spark, sf), 4
    pages.repartition(2 * files).write.parquet(f"{space.path}/pages")

    def sightings():
        links = stream_links(admit(spark, f"{space.path}/pages", pages.schema, max_files=files)).where("dst IS NOT NULL")
        keys = links.select(V.page_host("src").alias("site"), F.col("dst").alias("url"))
        return first_sightings(keys, ["site", "url"])

    run.run(sightings(), stop_after=1)
    return Run("stream-visited", folder=run.folder, store=ROCKSDB).run(sightings())


@query
def stream_rate_query(spark, sf):
    """The last state of each second, those still open at the end included."""
    rates = run_available(stream_rate(_event_stream(spark, sf)), "stream-rate", "update")
    return last_updates(rates, ["transfer_id", "second"]).select("transfer_id", Z.format_time("second").alias("second"), "rate")



@query
def stream_status_query(spark, sf):
    """Last state of each attempt, from messages that come in several batches."""
    space, files = Workspace(spark, "messages"), 8
    messages = V.messages(spark, sf)
    parts = V.time_slices(messages, 4)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(f"{space.path}/messages")
    stream = transfer_states(admit(spark, f"{space.path}/messages", messages.schema, max_files=files))
    states = last_states(run_available(stream, "stream-status", "update", ROCKSDB))
    at = [Z.format_time(c).alias(c) for c in ("started", "ended")]
    return states.select("transfer_id", *at, "phase", "total", "downloaded", "n", "avg_rate", "seconds")



@query
def stream_admission(spark, sf):
    pages = _page_stream(spark, sf, max_bytes="65536").select("page_id", "url", _big(F.octet_length("html"), "n_bytes"))
    return run_available(pages, "stream-admission")
