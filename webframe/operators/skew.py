"""Joins on keys of which a few hold a large share of the rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more rows than this share of a task's average; its rows are dealt in so many pieces a task.
SHARE, PIECES = 0.25, 8
#: Keys that the sketch follows for each task, so that its error is well below the share.
TRACKED = 32


def hot_keys(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame | None:
    """``(_hot, _pieces)`` for each key with a large share of the rows; None if there is none.

    One pass with a sketch of frequent items, whose size depends on ``tasks`` (by default the shuffle partitions)
    alone. There are at most ``tasks / SHARE`` such keys, whatever the size of the table.
    """
    spark = df.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = int(n / SHARE)
    sketch = F.expr(f"approx_top_k(`{key}`, {most}, {min(TRACKED * n, 1_000_000)})")
    found = df.where(F.col(key).isNotNull()).agg(sketch.alias("top"), F.count(F.lit(1)).alias("total")).first()
    hot = [(x["item"], ceil(PIECES * n * x["count"] / found.total)) for x in found.top or [] if x["count"] * most > found.total]
    if not hot:
        return None
    return spark.createDataFrame(hot, f"_hot {df.schema[key].dataType.simpleString()}, _pieces int")


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", salt: Column | None = None, tasks: int | None = None
) -> DataFrame:
    """``left.join(right, key, how)`` for ``inner`` and ``left``, without a key of ``left`` as one task.

    Rows of hot keys of ``left`` are dealt over pieces by ``salt`` (by default a hash of the whole row, so a
    lost task is worked out alike), and the rows of ``right`` with such a key are repeated for each piece. ``right``
    should have few rows of a key. ``left`` is read twice. The table of hot keys is bounded, see :func:`hot_keys`.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"cannot salt a join of kind {how!r}")
    hot = hot_keys(left, key, tasks)
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    salt = F.xxhash64(*[f"`{c}`" for c in left.columns]) if salt is None else salt
    dealt = left.withColumn("_salt", salt).join(hot, F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_piece", F.coalesce(F.pmod("_salt", "_pieces"), F.lit(0)).cast("int")).drop("_hot", "_pieces", "_salt")
    each = F.sequence(F.lit(0), F.coalesce(F.col("_pieces") - 1, F.lit(0)))
    repeated = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_piece", F.explode(each)).drop("_hot", "_pieces")
    return dealt.join(repeated, [key, "_piece"], how).drop("_piece")
