"""Which responses are followed, and which are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.common import as_col, with_once
from webframe.functions.globs import should_exclude, should_reject
from webframe.functions.urls import url_path

HTML = "text/html"
CSS = "text/css"


def allowed_status(status: Column | str, allowed) -> Column:
    """True for the listed codes; ``None`` allows every code."""
    return F.lit(True) if allowed is None else as_col(status).isin(*allowed)


def with_limits(df: DataFrame, rejects=(), excludes=(), url: str = "url", mime: str = "mime") -> DataFrame:
    """Adds ``wanted`` (body is read), ``traverse`` (links are followed) and ``keep``.

    HTML is always read and followed, so that links are found, but is not kept
    if a pattern matches it; other types are not even read then.
    """
    path = F.col("_path")
    # An unparsable URL is kept out, like one that a pattern matches.
    limited = path.isNull() | should_reject(path, rejects) | should_exclude(path, excludes)
    judged = with_once(with_once(df, _path=url_path(url)), keep=~limited)
    return (
        judged.withColumn("wanted", (F.col(mime) == HTML) | F.col("keep"))
        .withColumn("traverse", (F.col(mime) == HTML) | ((F.col(mime) == CSS) & F.col("keep")))
        .drop("_path")
    )


def mime_class(mime: Column | str) -> Column:
    """``html``, ``css`` or ``leaf``; no type is a leaf."""
    mime = as_col(mime)
    return F.when(mime == HTML, "html").when(mime == CSS, "css").otherwise("leaf")
