"""Links of pages and style sheets as rows, and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.common import let, memo, record, with_once
from webframe.functions.css import css_urls
from webframe.functions.html import html_links
from webframe.functions.urls import base_of, drop_fragment, resolve_with, url_host


def extract_links(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per link: the kept columns, ``pos``, ``kind``, ``tag``, ``link``."""
    keep = keep if keep is not None else [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(html_links(html)).alias("pos", "_l")).select(
        *keep,
        F.col("pos").cast("bigint"),
        F.col("_l.kind").alias("kind"),
        F.col("_l.tag").alias("tag"),
        F.col("_l.url").alias("link"),
    )


def extract_css_links(sheets: DataFrame, css: str = "css", keep: list[str] | None = None) -> DataFrame:
    """One row per ``url(...)`` of a style sheet, in the columns of ``extract_links``."""
    keep = keep if keep is not None else [c for c in sheets.columns if c != css]
    return sheets.select(*keep, F.posexplode(css_urls(css)).alias("pos", "link")).select(
        *keep,
        F.col("pos").cast("bigint"),
        F.lit("css").alias("kind"),
        F.lit("").alias("tag"),
        "link",
    )


@memo
def _with_targets(links: str, base: str, host: str, canonicalize: bool) -> Column:
    """Each link with its target and whether that is on the page's host.

    Done inside the array, so that filters on the target do not have it
    resolved a second time.
    """
    base, host = F.col(base), F.col(host)

    def one(link):
        dst = resolve_with(base, link["url"])
        if canonicalize:
            dst = drop_fragment(dst)

        def judge(dst):
            own = F.concat(base["origin"], F.lit("/"))
            return record(
                kind=link["kind"],
                tag=link["tag"],
                link=link["url"],
                dst=dst,
                same_host=F.coalesce(
                    F.when(host.isNull(), F.lit(False))
                    .when(dst.startswith(own) & base["origin"].endswith(host), host != "")
                    .otherwise(url_host(dst) == host),
                    F.lit(False),
                ),
            )

        return let(dst, judge)

    return F.transform(links, one)


def page_links(
    pages: DataFrame,
    url: str = "url",
    body: str = "html",
    mime: str | None = None,
    base_mode: str = "directory",
    canonicalize: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(src, links ARRAY<STRUCT<kind, tag, link, dst, same_host>>)``, a row per page, and the columns to ``keep``.

    ``dst`` is NULL for unresolvable links. With ``mime`` the body is read as
    HTML or CSS by its type, and rows of other types have no links. Nothing is
    shuffled, and the body ends here.
    """
    sheet = F.transform(
        css_urls(body), lambda u: record(kind=F.lit("css"), tag=F.lit(""), url=u)
    )
    found = html_links(body)
    if mime:
        found = F.when(F.col(mime) == "text/html", found).when(F.col(mime) == "text/css", sheet)
    parsed = pages.select(
        *keep,
        F.col(url).alias("src"),
        found.alias("_links"),
        base_of(url, base_mode).alias("_base"),
        url_host(url).alias("_host"),
    )
    targets = _with_targets("_links", "_base", "_host", canonicalize)
    return with_once(parsed, links=targets).select(*keep, "src", "links")


def explode_links(nested: DataFrame) -> DataFrame:
    """``(src, pos, kind, tag, link, dst, same_host)`` of :func:`page_links`."""
    return nested.select("src", F.posexplode("links").alias("pos", "_l")).select(
        "src", F.col("pos").cast("bigint"), "_l.kind", "_l.tag", "_l.link", "_l.dst", "_l.same_host"
    )


def resolve_links(pages: DataFrame, url: str = "url", body: str = "html", **options) -> DataFrame:
    """One row per link with its target; options as in :func:`page_links`."""
    return explode_links(page_links(pages, url, body, **options))


def adjacency(nested: DataFrame) -> DataFrame:
    """``(src, dsts)``: distinct targets on the host of each page.

    A page's links are brought down to distinct ones inside its row, before
    anything is shuffled.
    """
    own = F.filter("links", lambda x: x["same_host"])
    dsts = F.array_distinct(F.transform(own, lambda x: x["dst"]))
    return nested.select("src", dsts.alias("dsts")).where(F.size("dsts") > 0)


def split_unresolvable(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved links, and the side output of those that lead nowhere."""
    return links.where(F.col("dst").isNotNull()), links.where(F.col("dst").isNull())


def same_host_links(links: DataFrame) -> DataFrame:
    """Links whose target has the host and port of the page."""
    return links.where("same_host")


def links_per_page(nested: DataFrame) -> DataFrame:
    """Per page the number of links, of distinct links, and the list in order.

    Out of :func:`page_links`, for pages with links; no shuffle.
    """
    listed = F.transform("links", lambda x: x["link"])
    return nested.where(F.size("links") > 0).select(
        "src",
        F.size("links").cast("bigint").alias("n_links"),
        F.size(F.array_distinct(listed)).cast("bigint").alias("n_distinct"),
        listed.alias("links"),
    )
