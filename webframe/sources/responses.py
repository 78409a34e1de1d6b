"""The web snapshot: a table of responses keyed by requested URL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions import headers as H


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least one partition per core.

    Reading links out of documents is far dearer than reading the documents, so
    a table in fewer pieces than there are cores is dealt out first. A large
    table has pieces enough and comes through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def with_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Adds ``mime``, ``declared_length`` and ``filename`` from a header map."""
    return (
        df.withColumn("mime", H.mime_type(headers))
        .withColumn("declared_length", H.content_length(headers))
        .withColumn("filename", H.disposition_filename(headers))
    )


def fetch_error(allowed_status, wanted: Column | None = None, path: Column | None = None) -> Column:
    """First reason a request fails, in the order they are checked; else NULL.

    Expects ``status``, ``declared_length`` and ``body_length`` of the joined
    response. A body shorter than declared is an error, a longer one is cut by
    the transport and passes.
    """
    error = F.when(F.col("status").isNull(), "not_found")
    if wanted is not None:
        error = error.when(~wanted, "skipped")
    if allowed_status is not None:
        error = error.when(~F.col("status").isin(*allowed_status), "bad_status")
    if path is not None:
        error = error.when(path == "", "no_path")
    return error.when(
        (F.col("declared_length") >= 0) & (F.col("body_length") < F.col("declared_length")), "short_body"
    )


def fetch_join(
    frontier: DataFrame,
    responses: DataFrame,
    allowed_status=(200,),
    wanted: Callable[[], Column] | None = None,
) -> DataFrame:
    """Frontier rows with the narrow part of their response and an ``error``.

    The body stays in the snapshot; join it again where it is needed.
    """
    joined = frontier.join(responses, "url", "left")
    condition = wanted() if wanted is not None else None
    return joined.withColumn("error", fetch_error(allowed_status, condition))
