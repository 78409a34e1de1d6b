"""Links of saved documents turned into relative paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.common import record
from webframe.functions.css import rewrite_css
from webframe.functions.html import rewrite_html
from webframe.functions.paths import relative_path
from webframe.operators.skew import salted_join


def link_pairs(nested: DataFrame) -> DataFrame:
    """``(src, link, dst)``: each resolved link of a page once."""
    resolved = F.filter("links", lambda x: x["dst"].isNotNull())
    pairs = F.transform(resolved, lambda x: record(link=x["link"], dst=x["dst"]))
    return nested.select("src", F.explode(F.array_distinct(pairs)).alias("_p")).select("src", "_p.link", "_p.dst")


def link_targets(pairs: DataFrame, saved: DataFrame, keep_fragment: bool = False) -> DataFrame:
    """``(src, link, target)``: relative path of each link whose target was saved.

    ``pairs(src, link, dst)`` are distinct, ``saved(url, save_path)`` has unique
    URLs. Only keys and paths are joined; documents stay where they are. A target that very many pages link to is
    dealt over several tasks.
    """
    here = saved.select(F.col("url").alias("src"), F.col("save_path").alias("_from"))
    there = saved.select(F.col("url").alias("dst"), F.col("save_path").alias("_to"))
    target = relative_path("_from", "_to")
    if keep_fragment:
        target = F.concat(target, F.regexp_extract("link", "(?s)#.*", 0))
    return salted_join(pairs, there, "dst").join(here, "src").select("src", "link", target.alias("target"))


def link_maps(targets: DataFrame) -> DataFrame:
    """``(src, links MAP)``; a page's map is no larger than the page allows."""
    return targets.groupBy("src").agg(
        F.map_from_entries(F.collect_list(F.struct("link", "target"))).alias("links")
    )


def _lookup(links: Column) -> Callable[[Column], Column]:
    return lambda link: F.coalesce(F.try_element_at(links, link), link)


def convert_documents(
    docs: DataFrame, body: str = "body", mime: str = "mime", links: str = "links", out: str = "converted"
) -> DataFrame:
    """Adds HTML and CSS bodies with their links replaced by the map in ``links``.

    Documents of other types, or without a map, come through as they are.
    """
    lookup = _lookup(F.col(links))
    html = rewrite_html(body, lambda link, is_a: lookup(link))
    new = (
        F.when(F.col(links).isNull(), F.col(body))
        .when(F.col(mime) == "text/html", html)
        .when(F.col(mime) == "text/css", rewrite_css(body, lookup))
        .otherwise(F.col(body))
    )
    return docs.withColumn(out, new)
