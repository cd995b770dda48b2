"""Ordered analytics over groups of any size.

A plain window sends a whole group through one task. These helpers cut a group into blocks of its
integer position first: most of the work runs per (group, block), and the only window over the
whole group sees one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def _block(position: str, size: int) -> Column:
    return F.floor(F.col(position) / size)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    output: str,
    descending: bool = False,
    size: int = BLOCK,
) -> DataFrame:
    """Inclusive running sum of `value` by `position` within `keys`. Positions must be distinct."""
    direction = F.desc if descending else F.asc
    valued = df.withColumn("_value", value).withColumn("_block", _block(position, size))
    totals = valued.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    blocks = Window.partitionBy(*keys).orderBy(direction("_block")).rowsBetween(*_UP_TO_HERE)
    before = totals.withColumn("_before", F.sum("_total").over(blocks) - F.col("_total"))
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(direction(position)).rowsBetween(*_UP_TO_HERE)
    )
    return (
        valued.withColumn("_inside", F.sum("_value").over(inside))
        .join(before.drop("_total"), [*keys, "_block"])
        .withColumn(output, F.col("_before") + F.col("_inside"))
        .drop("_value", "_block", "_inside", "_before")
    )


def row_ordinal(
    df: DataFrame, keys: Sequence[str], position: str, output: str, size: int = BLOCK
) -> DataFrame:
    """Position 1..n of each row within its group."""
    return running_sum(df, keys, position, F.lit(1).cast("bigint"), output, size=size)


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    output: str,
    size: int = BLOCK,
) -> DataFrame:
    """`value` of the row before, by `position` within `keys`; null for the first row."""
    valued = df.withColumn("_value", value).withColumn("_block", _block(position, size))
    last = valued.groupBy(*keys, "_block").agg(
        F.max_by(F.struct(F.col("_value").alias("v")), position).alias("_last")
    )
    blocks = Window.partitionBy(*keys).orderBy("_block")
    carried = last.withColumn("_carried", F.lag("_last").over(blocks)).drop("_last")
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    return (
        valued.withColumn("_local", F.lag(F.struct(F.col("_value").alias("v"))).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(output, F.coalesce("_local", "_carried")["v"])
        .drop("_value", "_block", "_local", "_carried")
    )


def preceding_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    count: int,
    output: str,
    size: int = BLOCK,
) -> DataFrame:
    """`value` of up to `count` rows before, oldest first, by the integer columns `order` within `keys`.

    Blocks are cut by the first column of `order`. The window over a whole group sees the last values
    of each block.
    """
    valued = df.withColumn("_value", value).withColumn("_block", _block(order[0], size))
    backwards = Window.partitionBy(*keys, "_block").orderBy(*[F.desc(name) for name in order])
    cell = F.struct(F.struct(*order).alias("at"), F.col("_value").alias("v"))
    last = (
        valued.withColumn("_rank", F.row_number().over(backwards))
        .where(F.col("_rank") <= count)
        .groupBy(*keys, "_block")
        .agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["v"]).alias("_last"))
    )
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-count, -1)
    carried = last.withColumn("_carried", F.flatten(F.collect_list("_last").over(blocks))).drop("_last")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(-count, -1)
    newest = F.slice(F.reverse(F.concat("_carried", "_local")), 1, count)
    return (
        valued.withColumn("_local", F.collect_list("_value").over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(output, F.reverse(newest))
        .drop("_value", "_block", "_local", "_carried")
    )


def sorted_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[tuple[Column, bool]],
    order: Sequence[Column],
    output: str,
) -> DataFrame:
    """Position 1..n within `keys` by a sort that begins with two coarse levels.

    `levels` are (column, descending), coarse first; `order` sorts inside one cell of both levels and
    must begin where the levels end. Cells are counted, offsets summed over cells, and only the rows
    of one cell are ordered together.
    """
    (first, first_down), (second, second_down) = levels
    celled = df.withColumn("_l1", first).withColumn("_l2", second)
    cells = celled.groupBy(*keys, "_l1", "_l2").agg(F.count(F.lit(1)).alias("_n"))
    rows = cells.groupBy(*keys, "_l1").agg(F.sum("_n").alias("_m"))
    down = lambda name, descending: F.desc(name) if descending else F.asc(name)
    by_first = Window.partitionBy(*keys).orderBy(down("_l1", first_down)).rowsBetween(*_UP_TO_HERE)
    by_second = (
        Window.partitionBy(*keys, "_l1").orderBy(down("_l2", second_down)).rowsBetween(*_UP_TO_HERE)
    )
    rows = rows.withColumn("_before1", F.sum("_m").over(by_first) - F.col("_m")).drop("_m")
    cells = cells.withColumn("_before2", F.sum("_n").over(by_second) - F.col("_n")).drop("_n")
    offsets = cells.join(rows, [*keys, "_l1"]).withColumn(
        "_offset", F.col("_before1") + F.col("_before2")
    )
    inside = Window.partitionBy(*keys, "_l1", "_l2").orderBy(*order)
    return (
        celled.withColumn("_place", F.row_number().over(inside))
        .join(offsets.drop("_before1", "_before2"), [*keys, "_l1", "_l2"])
        .withColumn(output, F.col("_offset") + F.col("_place"))
        .drop("_l1", "_l2", "_place", "_offset")
    )
