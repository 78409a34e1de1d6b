"""Links of pages as they arrive, and first sightings of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from webframe.operators.extract import resolve_links


def stream_links(pages: DataFrame, url: str = "url", body: str = "html", **options) -> DataFrame:
    """Stateless: every arriving document gives its resolved links."""
    return resolve_links(pages, url, body, **options)


def first_sightings(urls: DataFrame, key: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose key was not seen before.

    The state grows with the keys; with ``watermark=(column, delay)`` a key is
    forgotten once the watermark has passed it.
    """
    if watermark is None:
        return urls.dropDuplicates(key)
    return urls.withWatermark(*watermark).dropDuplicatesWithinWatermark(key)
