"""Helpers shared by the column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def record(**fields: Column) -> Column:
    """A struct whose field names hold wherever the expression is placed."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once per row.

    A filter on a computed column is pushed below it with the whole expression
    in place of the name, which for a long one means working it out again for
    the filter. The output of a generator is not replaced in that way.
    """
    return df.select("*", F.inline(F.array(record(**columns))))


def memo(fn):
    """Builds the expression once per argument list of plain names.

    Putting a long expression together takes many calls into the JVM; the
    result depends on the names only and can be used in any plan.
    """
    built = {}

    @functools.wraps(fn)
    def cached(*args, **kwargs):
        values = (*args, *kwargs.values())
        if not all(v is None or isinstance(v, (str, int, bool, tuple)) for v in values):
            return fn(*args, **kwargs)
        key = (id(SparkContext._gateway), args, tuple(kwargs.items()))
        if key not in built:
            built[key] = fn(*args, **kwargs)
        return built[key]

    return cached


def let(value: Column | dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Without it an expression used twice is also planned twice, and nested uses
    multiply. A dictionary binds several values as the fields of a struct.
    """
    if isinstance(value, dict):
        value = record(**value)
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Longer than any string or array, yet safe to add a position to.
ALL = 2**30


def two_decimals(value: Column) -> Column:
    """Text with two decimals, ties decided on the exact binary value."""
    return F.call_function("format_number", value.cast("double"), F.lit("0.00"))
