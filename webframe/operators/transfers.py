"""Progress, rates and outcomes of transfers.

Transfers are rows ``(transfer_id, ts TIMESTAMP, event_id, bytes, kind)``; order
within a transfer is always ``(ts, event_id)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.sizes import format_size
from webframe.operators.prefix import running

ORDER = ["ts", "event_id"]


def _hour() -> Column:
    return F.floor(F.unix_seconds("ts") / 3600)


def running_bytes(transfers: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Adds ``downloaded``: bytes of the transfer up to and with each row."""
    bucket = _hour() if bucket is None else bucket
    return running(transfers, ["transfer_id"], ORDER, F.col("bytes"), "downloaded", bucket)


def throttle_schedule(transfers: DataFrame, limit: int, bucket: Column | None = None) -> DataFrame:
    """Adds ``done_second``: when each row is through at ``limit`` bytes per second.

    For a transfer that always has data waiting; no limit means second 0.
    """
    done = running_bytes(transfers, bucket)
    if limit <= 0:
        return done.withColumn("done_second", F.lit(0).cast("bigint"))
    second = F.greatest(F.floor((F.col("downloaded") - 1) / limit), F.lit(0).cast("bigint"))
    return done.withColumn("done_second", second.cast("bigint"))


def rate_per_second(transfers: DataFrame, zero_fill: bool = False, tick: str = "1 second") -> DataFrame:
    """``(transfer_id, second, rate)``: bytes in each tick, named by its start.

    ``zero_fill`` adds the ticks without bytes between a transfer's first and
    last; they are laid out in runs of an hour of ticks, so that no row holds a long array. ``tick`` is a
    whole number of seconds that divides a day.
    """
    second = F.window("ts", tick)["start"]
    rates = transfers.groupBy("transfer_id", second.alias("second")).agg(F.sum("bytes").alias("rate"))
    if not zero_fill:
        return rates
    length = F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {tick}"))
    at = F.floor(F.unix_seconds("ts") / length)
    span = transfers.groupBy("transfer_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    run = F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("b") / 3600))).alias("h")
    first, last = F.greatest("a", F.col("h") * 3600), F.least("b", F.col("h") * 3600 + 3599)
    ticks = span.select("transfer_id", "a", "b", run).select("transfer_id", F.explode(F.sequence(first, last)).alias("t"))
    ticks = ticks.select("transfer_id", F.timestamp_seconds(F.col("t") * length).alias("second"))
    return ticks.join(rates, ["transfer_id", "second"], "left").withColumn("rate", F.coalesce("rate", F.lit(0)))


def next_average(average: int, rate: int, n: int) -> int:
    """Mean of ``n`` earlier rates and a new one, cut to a whole number."""
    return int((float(average) * n + float(rate)) / (n + 1))


def average_rates(rates: DataFrame) -> DataFrame:
    """``(transfer_id, n, avg_rate)``: running mean, truncated at every step.

    Each step depends on the truncated one before, so a transfer is followed in
    order. All that does not depend on it is done apart, by as many tasks as there are hours of transfers: rates are sorted and
    packed into one row an hour. What is left for the one that follows a transfer is a row an hour, and one division a second.
    """
    hours = (
        rates.where("rate > 0")
        .groupBy("transfer_id", F.floor(F.unix_seconds("second") / 3600).alias("hour"))
        .agg(F.sort_array(F.collect_list(F.struct("second", "rate"))).alias("ticks"))
        .select("transfer_id", "hour", F.transform("ticks", lambda t: t["rate"]).alias("rates"))
    )
    ordered = hours.repartition("transfer_id").sortWithinPartitions("transfer_id", "hour").select("transfer_id", "rates")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, average, n = None, 0, 0

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["transfer_id", "n", "avg_rate"])

        for batch in batches:
            done = []
            lists = batch.column(1)
            ends, flat = lists.offsets.to_pylist(), lists.values.to_pylist()
            for k, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                if k != key:
                    if n:
                        done.append((key, n, average))
                    key, average, n = k, 0, 0
                for rate in flat[a:b]:
                    average = next_average(average, rate, n)
                    n += 1
            yield rows(done)
        if n:
            yield rows([(key, n, average)])

    return ordered.mapInArrow(follow, "transfer_id bigint, n bigint, avg_rate bigint")


def final_status(transfers: DataFrame, averages: DataFrame, totals: DataFrame, failed_kind: str = "error") -> DataFrame:
    """One row per transfer: outcome, bytes, total, whole seconds and mean rate.

    A transfer whose last event is ``failed_kind`` failed. ``totals(transfer_id, total)`` are the declared lengths, -1 where unknown.
    A finished transfer has a total, its bytes if none was declared. Without a rate, the
    bytes themselves stand for it: the transfer took less than a second.
    """
    last = transfers.groupBy("transfer_id").agg(
        F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"),
        F.sum("bytes").alias("downloaded"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    )
    seconds = F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1_000_000)
    rate = F.coalesce(F.nullif(F.col("avg_rate"), F.lit(0)), F.col("downloaded"))
    failed, declared = F.col("last_kind") == failed_kind, F.coalesce("total", F.lit(-1))
    total = F.when((declared == -1) & ~failed, F.col("downloaded")).otherwise(declared)
    facts = last.join(averages.select("transfer_id", "avg_rate"), "transfer_id", "left")
    return facts.join(totals.select("transfer_id", "total"), "transfer_id", "left").select(
        "transfer_id",
        failed.alias("failed"),
        "downloaded",
        total.cast("bigint").alias("total"),
        seconds.cast("bigint").alias("seconds"),
        rate.alias("avg_rate"),
    )


def mirror_summary(requests: DataFrame) -> DataFrame:
    """``(files, bytes, size_text, seconds)`` over all requests, failed ones too."""
    seconds = F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000)
    totals = requests.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        seconds.cast("bigint").alias("seconds"),
    )
    return totals.withColumn("size_text", format_size("bytes"))


def outcomes(results: DataFrame) -> DataFrame:
    """``(outcome, n_urls)``: how many URLs succeeded or failed, and why."""
    return results.groupBy(F.coalesce("error", F.lit("success")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_urls")
    )


def body_check(body: Column, declared: Column) -> Column:
    """``ok``, ``short``, ``long`` or ``unchecked`` (no declared length)."""
    n = F.octet_length(body).cast("bigint")
    return (
        F.when(declared < 0, "unchecked")
        .when(n < declared, "short")
        .when(n > declared, "long")
        .otherwise("ok")
    )


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)
