"""Results written through Spark's own job commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions.paths import escapes_root


def write_saved(df: DataFrame, target: str, partition: str | None = "host", spread: int | None = None) -> DataFrame:
    """Writes one row per saved file and returns the refused rows, with their bodies left out.

    Refused are empty paths, paths that climb above their start, and rows whose
    column ``escapes_root``, if there is one, is true (see ``Mirror.manifest``).
    Rows of one host are dealt to ``spread`` files by their path, as many as the
    session has shuffle partitions unless told otherwise, so a large host is not written by one task.
    """
    bad = escapes_root("save_path") | (F.col("save_path") == "")
    if "escapes_root" in df.columns:
        bad = bad | F.col("escapes_root")
    bad = F.coalesce(bad, F.lit(True))
    safe = df.where(~bad)
    if partition is None:
        safe.write.mode("overwrite").parquet(target)
    else:
        n = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = safe.repartition(F.col(partition), F.pmod(F.xxhash64("save_path"), F.lit(n)))
        salted.write.mode("overwrite").partitionBy(partition).parquet(target)
    return df.where(bad).drop("body")


def success_list(results: DataFrame) -> DataFrame:
    """URLs that were fetched without an error."""
    return results.where(F.col("error").isNull()).select("url")
