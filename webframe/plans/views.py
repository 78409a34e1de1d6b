"""Inputs derived from the given tables: responses, a linked site, transfers.

The pages do not link to each other, so the site view numbers the pages of each
host and links page ``n`` to ``2n`` and ``2n + 1``, back to the first page, off
the host, and to a style sheet that needs an image. The page's own text, with
its own links, stays part of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions.html import html_links
from webframe.operators.prefix import running
from webframe.sources.responses import spread, with_headers


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(*parts) -> Column:
    """Strings and columns put together."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"))


def page_host(url: str = "url") -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]*)", 1)


def variants(df: DataFrame, forms: list[Column], out: str) -> DataFrame:
    """Every row once per form, numbered from 0."""
    return df.select("*", F.posexplode(F.array(*forms)).alias("variant", out)).withColumn(
        "variant", F.col("variant").cast("bigint")
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as responses of several types, with missing and wrong headers."""
    i = F.col("page_id")
    kind = (
        F.when(i % 5 == 0, "text/css; charset=utf-8")
        .when(i % 5 == 1, " image/png ")
        .when(i % 5 == 2, "")
        .otherwise("text/html; charset=utf-8")
    )
    n = F.octet_length("html").cast("bigint")
    length = F.when(i % 17 == 0, "abc").otherwise((n + F.when(i % 13 == 0, 1).otherwise(0)).cast("string"))
    file = F.when(i % 6 == 0, text('attachment; filename="f', i, '.txt"'))
    headers = F.map_filter(
        F.create_map(
            F.lit("Content-Type"), F.array(kind, F.lit("text/x-second")),
            F.lit("content-length"), F.array(length),
            F.lit("CONTENT-DISPOSITION"), F.array(file),
        ),
        lambda k, v: v[0].isNotNull(),
    )
    return with_headers(
        pages(spark, sf).select(
            "page_id",
            "url",
            F.when(i % 11 == 0, 404).otherwise(200).alias("status"),
            headers.alias("headers"),
            n.alias("body_length"),
            F.col("html").alias("body"),
        )
    )


def decorated(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with style sheets, inline styles and images put in."""
    i = F.col("page_id")
    sheet = text(
        "<style>p{margin:0;background:url('/bg/", i, ".png')} /* url(no.png) */ @import url(/css/", i % 7, ".css);</style>"
    )
    ad = text(
        '<div class="ad" style="background:url(&quot;/ad/', i % 13, '.png&quot;)"><IMG alt=">" src=/img/', i, ".jpg>"
    )
    html = F.replace(F.col("html"), F.lit("<style>p{margin:0}</style>"), sheet)
    return pages(spark, sf).select(
        "page_id", "url", F.replace(html, F.lit('<div class="ad">'), ad).alias("html")
    )


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose links are written in other ways: a third in single quotes and capitals, a third without quotes."""
    link = "<a href=\"([^\"'`=<>\\s]+)\""
    html = (
        F.when(F.col("page_id") % 3 == 1, F.regexp_replace("html", link, "<A Title=x\nHREF = '$1'"))
        .when(F.col("page_id") % 3 == 2, F.regexp_replace("html", link, "<a href=$1"))
        .otherwise(F.col("html"))
    )
    return pages(spark, sf).withColumn("html", html)


def own_links(html: str = "html") -> Column:
    """What the anchors of a page link to, in order."""
    anchors = F.filter(html_links(html), lambda x: (x["kind"] == "attr") & (x["tag"] == "a"))
    return F.transform(anchors, lambda x: x["url"])


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A style sheet per page, with a rule for each of its links.

    Links are quoted in turn; every fourth one is only text in a string, and a
    comment names a URL too.
    """
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))

    def rule(link, i):
        return F.concat(
            F.lit(".r"), i.cast("string"),
            F.when(i % 4 == 0, text('{background:url("', link, '")}'))
            .when(i % 4 == 1, text("{background:url( '", link, "' )}"))
            .when(i % 4 == 2, text("{background:url(", link, ")}"))
            .otherwise(text("{content:\"url('", link, "')\"}")),
        )

    css = F.concat(F.lit("/* url(/comment.png) */ "), F.array_join(F.transform(links, rule), "\n"))
    return pages(spark, sf).select("page_id", "url", css.alias("css"))


def numbered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``(h, n, html)``: pages of each host numbered by ``page_id``."""
    hosts = pages(spark, sf).select("page_id", page_host().alias("h"), "html")
    narrow = hosts.drop("html")
    bucket = F.floor(F.col("page_id") / 1000)
    ranked = running(narrow, ["h"], ["page_id"], F.lit(1).cast("bigint"), "n", bucket)
    return ranked.join(hosts.select("page_id", "html"), "page_id")


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``(h, n, url, html)`` of the linked site."""
    n = F.col("n")
    nav = text(
        '<link rel="stylesheet" href="/s/', n, '.css"><a href="/p/', 2 * n, '">l</a><a href="/p/', 2 * n + 1,
        '">r</a><a href="/p/1">up</a><a href="/p/', 2 * n, '">l again</a><a href="http://other.example.org/x">off</a>'
        '<a href="mailto:x@', F.col("h"), '">mail</a>',
    )
    return numbered_pages(spark, sf).select(
        "h", "n", text("http://", F.col("h"), "/p/", n).alias("url"), F.concat(nav, "html").alias("html")
    )


def site(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of the linked site: pages, style sheets and images.

    Every seventh page is missing, every fourth style sheet is an empty image.
    """
    numbered = site_pages(spark, sf)
    n, h = F.col("n"), F.col("h")
    kinds = F.array(
        F.struct(
            F.col("url").alias("url"), F.when(n % 7 == 0, 404).otherwise(200).alias("status"),
            F.lit("text/html").alias("mime"), F.col("html").alias("body"),
        ),
        F.struct(
            text("http://", h, "/s/", n, ".css").alias("url"), F.lit(200).alias("status"),
            F.when(n % 4 == 0, "image/png").otherwise("text/css").alias("mime"),
            text("a{b:url('/i/", n, ".png')} c{d:url(/s/", n + 1, ".css)}").alias("body"),
        ),
        F.struct(
            text("http://", h, "/i/", n, ".png").alias("url"), F.lit(200).alias("status"),
            F.lit("image/png").alias("mime"), F.lit("png").alias("body"),
        ),
    )
    rows = numbered.select("h", "n", F.inline(kinds))
    length = F.octet_length("body").cast("bigint")
    return rows.select(
        "h", "n", "url", "status", "mime",
        length.alias("declared_length"), F.lit(None).cast("string").alias("filename"),
        length.alias("body_length"), "body",
    )


def site_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """One seed per host, its first page; the seed's number is its ``page_id``."""
    return (
        pages(spark, sf)
        .groupBy(page_host().alias("h"))
        .agg(F.min("page_id").alias("seed_id"))
        .select("seed_id", text("http://", F.col("h"), "/p/1").alias("url"))
    )


def redirect_hops(spark: SparkSession, sf: str) -> DataFrame:
    """``(url, target)`` among the numbered pages of each host: short chains, long ones, and cycles."""
    n = F.col("n")
    target = (
        F.when(n % 3 == 0, F.floor(n / 3)).when(n % 10 == 5, n + 5).when(n % 10 == 0, n - 5).when(n % 2 == 1, n + 6)
    )
    hops = numbered_pages(spark, sf).select("h", "n", target.alias("to")).where("to IS NOT NULL")
    return hops.select(text("http://", F.col("h"), "/p/", n).alias("url"), text("http://", F.col("h"), "/p/", F.col("to")).alias("target"))


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("transfer_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
        F.col("event_type").alias("kind"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages of transfers: starts, lengths, progress, ends and failures."""
    kinds = {"signup": "start", "view": "length", "click": "progress", "purchase": "finished", "error": "failed"}
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return transfers(spark, sf).withColumn("kind", F.try_element_at(table, F.col("kind")))


def time_slices(df: DataFrame, n: int, ts: str = "ts") -> list[DataFrame]:
    """The rows in ``n`` parts of equal time, one after another."""
    first, last = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    if first is None:
        return [df]
    part = F.least(F.floor((F.unix_micros(ts) - first) * n / (last - first + 1)), F.lit(n - 1))
    return [df.where(part == k) for k in range(n)]
