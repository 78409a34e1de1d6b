"""Byte sizes, rates, percentages and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions.common import as_col, let, two_decimals

# Fixed value: shown where the remaining time is unknown.
UNKNOWN_ETA = "\U0001f55b"


def format_size(n: Column | str) -> Column:
    """Binary units with two decimals; plain bytes below 1024."""
    n = as_col(n)

    def scaled(power: int, unit: str) -> Column:
        return F.concat(two_decimals(n / F.lit(float(2**power))), F.lit(f" {unit}"))

    return (
        F.when(n >= 2**30, scaled(30, "GiB"))
        .when(n >= 2**20, scaled(20, "MiB"))
        .when(n >= 2**10, scaled(10, "KiB"))
        .when(n < 0, "--.- B")
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def round_bytes(n: Column | str) -> Column:
    """Decimal megabytes, or gigabytes from one gigabyte on."""
    n = as_col(n)
    return F.when(n < 10**9, F.concat(two_decimals(n / F.lit(1e6)), F.lit("MB"))).otherwise(
        F.concat(two_decimals(n / F.lit(1e9)), F.lit("GB"))
    )


def parse_rate(text: Column | str) -> Column:
    """Bytes per second of ``20k``, ``1.5M`` or ``300``; 0 if unreadable."""
    text = as_col(text)
    number = F.regexp_extract(text, r"(?s)\A(.*[0-9])", 1)
    suffix = F.substring(text, F.length(number) + 1, F.length(text))
    readable = number.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    # A double keeps the sign and size of any number; FLOOR alone would give BIGINT.
    value = F.when(readable, number.try_cast("double"))
    value = F.when(F.abs(value) < 9e15, F.floor(value).cast("double")).otherwise(value)
    factor = F.when(F.trim(suffix) == "", 1.0).when(suffix == "k", 1e3).when(suffix == "M", 1e6)
    scaled = value * factor
    return F.coalesce(
        F.when(F.abs(scaled) < 9.2e18, scaled.cast("bigint")), F.lit(0)
    ).cast("bigint")


def percent_complete(done: Column | str, total: Column | str) -> Column:
    done, total = as_col(done), as_col(total)
    value = (done * 100).cast("double") / total.cast("double")
    return F.when(total <= 0, "--.-%").otherwise(F.concat(two_decimals(value), F.lit("%")))


def format_duration(seconds: Column | str) -> Column:
    """Whole seconds as ``1h2m3s``, ``2m3s`` or ``3s``."""
    s = as_col(seconds)
    a = F.abs(s)
    hours, minutes, rest = F.floor(a / 3600), F.floor(a % 3600 / 60), a % 60

    def text(value: Column, unit: str) -> Column:
        return F.concat(value.cast("bigint").cast("string"), F.lit(unit))

    return F.concat(
        F.when(s < 0, "-").otherwise(""),
        F.when(a >= 3600, text(hours, "h")).otherwise(""),
        F.when(a >= 60, text(minutes, "m")).otherwise(""),
        text(rest, "s"),
    )


def eta(done: Column | str, total: Column | str, rate: Column | str) -> Column:
    """Time left at the present rate, or a clock glyph if that is unknown."""
    done, total, rate = as_col(done), as_col(total), as_col(rate)
    left = ((total - done).cast("double") / F.nullif(rate, F.lit(0)).cast("double")).cast("bigint")
    return F.when((done == 0) | (total < 0) | (rate == 0), UNKNOWN_ETA).otherwise(
        let(left, format_duration)
    )


def format_time(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd HH:mm:ss")


def status_lines(kind: Column, ts: Column, status: Column, length: Column, path: Column, url: Column) -> Column:
    """One line of text per transfer event, without terminal codes."""
    # The texts that a user reads.
    return (
        F.when(kind == "start", F.concat(F.lit("start at "), format_time(ts)))
        .when(
            kind == "status",
            F.concat(
                F.lit("sending request, awaiting response... "),
                F.when(status.isNull(), "").otherwise(F.concat(F.lit("status "), status)),
            ),
        )
        .when(
            kind == "length",
            F.when(
                length < 0, F.concat(F.lit("content size: unspecified [~"), format_size(length), F.lit("]"))
            ).otherwise(
                F.concat(
                    F.lit("content size: "), length.cast("string"), F.lit(" [~"), round_bytes(length), F.lit("]")
                )
            ),
        )
        .when(kind == "file", F.concat(F.lit("saving file to: "), path))
        .when(
            (kind == "finished") & (F.coalesce(url, F.lit("")) == ""),
            F.concat(F.lit("failed at "), format_time(ts)),
        )
        .when(
            kind == "finished",
            F.concat(F.lit("Downloaded ["), url, F.lit("] finished at "), format_time(ts)),
        )
    )
