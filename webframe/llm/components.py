"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webframe.llm.common import Scratch


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of an edge between two nodes; root is the smallest node of its component.

    Each round writes its edges to the shared folder, until one changes nothing: then every node has one edge to a node
    that has none. The number of rounds is logarithmic in the number of nodes.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    level, changed = 0, True
    while changed:
        level += 1
        now = scratch.save(_round(now.select("u", "v")), f"{name}-{level}")
        changed = not now.where("changed").isEmpty()
        scratch.drop(f"{name}-{level - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _round(edges: DataFrame) -> DataFrame:
    """A large star, then a small one: the edges (u, v) with u > v after them, and whether they ``changed``.

    Each star is one shuffle by node. A node's neighbours are read in the order of a window, which spills, and each
    is joined to the least one.
    """
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = _with_least(edges.select(F.inline(ends)), F.lit(False)).where("v > u")
    large = both.select(F.col("v").alias("u"), F.least("u", "m").alias("v"), (F.col("m") < F.col("u")).alias("changed"))
    held = _with_least(large, F.col("changed"))
    other = F.col("v") != F.col("m")
    return held.select(F.when(other, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), (other | F.col("changed")).alias("changed"))


def _with_least(edges: DataFrame, changed: Column) -> DataFrame:
    """The distinct (u, v) with the least v of each u as ``m``; dealt once, as u is part of what is grouped."""
    dealt = edges.repartition("u").groupBy("u", "v").agg(F.max(changed).alias("changed"))
    return dealt.withColumn("m", F.min("v").over(Window.partitionBy("u")))
