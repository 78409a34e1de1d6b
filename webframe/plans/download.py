"""Plain download of a list of URLs from a snapshot of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions.paths import output_path
from webframe.operators.pathset import unique_names
from webframe.options import MirrorOptions
from webframe.sources.responses import fetch_join


def download(
    seeds: DataFrame,
    responses: DataFrame,
    options: MirrorOptions = MirrorOptions(mirror=False),
    existing: DataFrame | None = None,
) -> DataFrame:
    """``(ordinal, url, save_path, status, error)`` for ``seeds(ordinal, url)``.

    The same URL may come several times; each gets a file of its own.
    """
    named = seeds.withColumn("name", output_path("url", options.save_path, options.output_file))
    placed = unique_names(named, existing)
    facts = responses.select("url", "status", "declared_length", "body_length")
    return fetch_join(placed, facts, options.allowed_status).select(
        "ordinal", "url", F.col("unique_name").alias("save_path"), "status", "error"
    )
