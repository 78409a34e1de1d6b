"""Facts of a snapshot: one response per URL, and where redirects end."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions.urls import absolute_url
from webframe.operators.skew import salted_join
from webframe.sources.staging import Workspace

#: Status codes that send on, and how many hops a client follows.
REDIRECTS, MAX_HOPS = (301, 302, 303, 307, 308), 10


def latest_responses(responses: DataFrame, fetched: str, tie: str | None = None) -> DataFrame:
    """One response per URL out of many crawls: the one fetched last, of several then the one with the largest ``tie``.

    Which it is follows from the narrow columns, which are aggregated before anything moves; rows that are left out
    do not move at all where Spark can send the keys to them. Rows equal in URL, time and tie are one.
    """
    order = [fetched, tie] if tie else [fetched]
    last = responses.groupBy("url").agg(F.max(F.struct(*order)).alias("_last"))
    keyed = responses.withColumn("_order", F.struct(*order))
    same = keyed["url"].eqNullSafe(last["url"]) & keyed["_order"].eqNullSafe(last["_last"])
    return keyed.join(last, same, "left_semi").drop("_order").dropDuplicates(["url"])


def follow_redirects(hops: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """``(url, final_url, n_hops, error)`` for each row of ``hops(url, target)`` with unique URLs.

    Every round doubles how far each URL looks ahead, so chains of ``max_hops`` take its logarithm of rounds. What has
    not ended by then, as cycles never do, is ``too_many_redirects``. Only URLs move, and a target that very many URLs
    lead to is dealt over several tasks.
    """
    space = Workspace(hops.sparkSession, "redirects")
    first = hops.select("url", F.col("target").alias("at"), F.lit(1).cast("bigint").alias("n"))
    state, _ = space.write(first, "round-0")
    for k in range(1, ceil(log2(max_hops + 1)) + 1):
        ahead = state.select(F.col("url").alias("at"), F.col("at").alias("_next"), F.col("n").alias("_more"))
        far = salted_join(state, ahead, "at", "left")
        far = far.select("url", F.coalesce("_next", "at").alias("at"), (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"))
        state, _ = space.write(far, f"round-{k}")
    going = hops.select(F.col("url").alias("at"), F.lit(True).alias("_going"))
    ended = salted_join(state, going, "at", "left")
    failed = F.coalesce("_going", F.lit(False)) | (F.col("n") > max_hops) | F.col("at").isNull()
    return ended.select(
        "url", F.when(~failed, F.col("at")).alias("final_url"), F.when(~failed, F.col("n")).alias("n_hops"),
        F.when(failed, "too_many_redirects").alias("error"),
    )


def redirect_hops(responses: DataFrame, location: str = "location") -> DataFrame:
    """``(url, target)`` of the responses that send on; a location is taken relative to the URL."""
    sent = responses.where(F.col("status").isin(*REDIRECTS) & F.col(location).isNotNull())
    return sent.select("url", absolute_url("url", location, "rfc3986").alias("target"))


def with_redirects(responses: DataFrame, location: str = "location", max_hops: int = MAX_HOPS) -> DataFrame:
    """Each URL with the response that its redirects end at, as a client sees it.

    ``responses`` has one row per URL. The result has the same rows and columns without ``location``, and
    ``final_url`` and ``redirect_error``. A chain that ends at a URL without a response is not found; one that does not end has
    the error ``too_many_redirects``. Bodies of redirect targets are moved, all others stay.
    """
    hops = redirect_hops(responses, location)
    moved = follow_redirects(hops, max_hops)
    facts = [c for c in responses.columns if c not in ("url", location)]
    sent = F.col("status").isin(*REDIRECTS) & F.col(location).isNotNull()
    direct = responses.where(~F.coalesce(sent, F.lit(False)))
    own = direct.select("url", *facts, F.col("url").alias("final_url"), F.lit(None).cast("string").alias("redirect_error"))
    at_end = direct.select(F.col("url").alias("final_url"), *facts)
    led = salted_join(moved.select("url", "final_url", F.col("error").alias("redirect_error")), at_end, "final_url", "left")
    return own.unionByName(led.select(*own.columns))
