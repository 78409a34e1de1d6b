"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive blocks of bytes of their normalised text. A
block is one digit; it is followed by whether the text ends in it. Groups of
one row leave after any round, groups whose text has ended are duplicates, and
only the rest goes on with its remaining bytes. Blocks grow geometrically, so
a text of n bytes takes O(log n) rounds. Rows are compared byte by byte; no
digest takes part in the decision.

A round counts (group, block) with map-side combining and joins the counts back.
Counts have unique keys, so a group that holds most rows is one row there and
many rows on the other side, which Spark splits when the partition is skewed.
The counts grow with the input, so they are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import Scratch, normal_spaces


def _digit(column: str, size: int) -> list[Column]:
    return [
        F.substring(column, 1, size).alias("_digit"),
        (F.octet_length(column) <= size).alias("_ended"),
    ]


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_block: int = 32, growth: int = 8
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one
    space; a null text is empty. The row with the smallest id of a group stays, a
    null id only if all are null; of repeated rows with that id exactly one stays.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = normal_spaces(F.col(text_col))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    rest = F.encode("_text", "UTF-8").alias("_rest")

    first = base.select(rest).select(*_digit("_rest", first_block))
    shared = first.groupBy("_digit", "_ended").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Ids of groups are numbers of rows of a written table, so they stay the same when a task is repeated.
    shared = scratch.save(shared.select("_digit", "_ended", F.monotonically_increasing_id().alias("_group")), "groups-0")
    rows = base.select(
        "_id", F.monotonically_increasing_id().alias("_row"), F.sha2("_text", 256).alias("_sha"), rest
    ).select("*", *_digit("_rest", first_block))
    joined = rows.join(shared.hint("merge"), ["_digit", "_ended"], "left")
    state = joined.select(
        "_id",
        "_row",
        "_sha",
        F.col("_id").alias("_keep"),
        F.lit(1).cast("long").alias("_size"),
        F.lit(True).alias("_kept"),
        "_group",
        F.when(F.col("_group").isNotNull(), F.expr(f"substring(_rest, {first_block + 1})")).alias("_rest"),
        F.col("_group").isNotNull().alias("_open"),
    )
    done, size, level = [], first_block, 0
    while True:
        written = scratch.save(state, f"state-{level}", "_open")
        scratch.drop(f"groups-{level}", *([f"state-{level - 1}/_open=true"] if level else []))
        done.append(written.where(~F.col("_open")))
        open_rows = written.where("_open")
        if open_rows.isEmpty():
            break
        level, size = level + 1, size * growth
        state = _split(scratch, open_rows, level, size)
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    return settled.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _split(scratch: Scratch, open_rows: DataFrame, level: int, size: int) -> DataFrame:
    """Splits each open group by its next ``size`` bytes."""
    rows = open_rows.select("_id", "_row", "_sha", "_group", "_rest", *_digit("_rest", size))
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    counts = rows.groupBy("_group", "_digit", "_ended").agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    # Row ids are unique over the whole job, so the first row's names the group.
    counts = scratch.save(counts.where("_n > 1"), f"groups-{level}")
    joined = rows.join(counts.hint("merge"), ["_group", "_digit", "_ended"], "left")
    alone = F.col("_n").isNull()
    on = ~alone & ~F.col("_ended")
    return joined.select(
        "_id",
        "_row",
        "_sha",
        F.when(alone, F.col("_id")).otherwise(F.col("_first.id")).alias("_keep"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("_size"),
        (alone | (F.col("_first.row") == F.col("_row"))).alias("_kept"),
        F.when(on, F.col("_first.row")).alias("_group"),
        F.when(on, F.expr(f"substring(_rest, {size + 1})")).alias("_rest"),
        on.alias("_open"),
    )
