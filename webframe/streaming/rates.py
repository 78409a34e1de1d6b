"""Rates of running transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rate(transfers: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Bytes per transfer and second, one row per second once it is over."""
    return (
        transfers.withWatermark("ts", delay)
        .groupBy("transfer_id", F.window("ts", "1 second").alias("_w"))
        .agg(F.sum("bytes").alias("rate"))
        .select("transfer_id", F.col("_w.start").alias("second"), "rate")
    )
