"""Seed lists: text files and arguments, validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions.urls import validate_url, with_default_scheme

_MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")


def validated(df: DataFrame, raw: str = "raw", mode: str = "PERMISSIVE") -> DataFrame:
    """Adds ``url`` and ``_error``; order and duplicates of the input are kept.

    ``FAILFAST`` stops the job at the first bad row, ``DROPMALFORMED`` leaves
    bad rows out, ``PERMISSIVE`` keeps them with the reason in ``_error``.
    """
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {_MODES}")
    checked = df.withColumn("_seed", validate_url(F.col(raw)))
    if mode == "FAILFAST":
        message = F.concat(F.lit("bad URL "), F.col(raw), F.lit(": "), F.col("_seed.error"))
        url = F.when(F.col("_seed.valid"), F.col("_seed.url")).otherwise(F.raise_error(message))
        return checked.select(*df.columns, url.alias("url"))
    out = checked.select(*df.columns, F.col("_seed.url").alias("url"), F.col("_seed.error").alias("_error"))
    return out.where("_error IS NULL").drop("_error") if mode == "DROPMALFORMED" else out


def read_url_list(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """One URL per line, blanks around it ignored."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("raw"))
    return validated(lines, "raw", mode)


def seed_union(*lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lists one after the other: the good seeds, and the rejected rows."""
    both = None
    for df in lists:
        part = validated(df.select("raw"))
        both = part if both is None else both.unionByName(part)
    good = both.where("_error IS NULL").select("raw", "url")
    return good, both.where("_error IS NOT NULL").select("raw", "_error")


def mirror_seeds(df: DataFrame, url: str = "url") -> DataFrame:
    """Seeds of a mirror with ``http`` as default scheme; bad ones left out."""
    return df.withColumn(url, with_default_scheme(url)).where(F.col(url).isNotNull())
