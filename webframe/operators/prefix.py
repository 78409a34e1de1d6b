"""Running aggregates that do not put a whole key into one task.

A plain window gives all rows of a key to one task. Here rows are first cut
into buckets along the order; each bucket is scanned on its own and starts from
the aggregate of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {
    "sum": (F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    bucket: Column,
    how: str = "sum",
) -> DataFrame:
    """Adds ``out``: the sum or maximum of ``value`` up to and with each row.

    ``bucket`` must not decrease along ``order``; take it fine enough that one
    bucket of one key fits a task.
    """
    agg, combine = _COMBINE[how]
    # One struct as key: NULLs in it are equal, and the join and the window
    # below it share a single shuffle of the rows.
    rows = df.withColumn("_key", F.struct(*keys, bucket.alias("_bucket"))).withColumn("_value", value)
    earlier = (
        Window.partitionBy(*[F.col("_key")[k] for k in keys])
        .orderBy(F.col("_key._bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = (
        rows.groupBy("_key")
        .agg(agg("_value").alias("_total"))
        .select("_key", agg("_total").over(earlier).alias("_before"))
    )
    inside = (
        Window.partitionBy("_key")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = rows.join(whole, "_key", "left")
    return joined.withColumn(out, combine(F.col("_before"), agg("_value").over(inside))).select(
        *df.columns, out
    )
