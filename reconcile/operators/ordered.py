"""Ordered passes that stay parallel inside one large group.

A plain window runs a whole group in one task.  Here a group is cut into blocks
of consecutive order values; the pass runs per block, and what a block inherits
from the blocks before it comes from a second pass over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 4096


def _inherited(df: DataFrame, by: list[str], block: str, order: str, value: Column) -> DataFrame:
    """Per block the last non-null ``value`` of all earlier blocks."""
    ends = df.groupBy(*by, block).agg(
        F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias("_end")
    )
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *by, block, F.last("_end", ignorenulls=True).over(before).alias("_carry")
    )


def fill_forward(
    df: DataFrame, by: list[str], block: str, order: str, value: str, out: str
) -> DataFrame:
    """``out``: the latest non-null ``value`` up to and including the row."""
    here = Window.partitionBy(*by, block).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    filled = df.withColumn("_inner", F.last(value, ignorenulls=True).over(here))
    carry = _inherited(df, by, block, order, F.col(value))
    return filled.join(carry, [*by, block], "left").withColumn(
        out, F.coalesce("_inner", "_carry")
    ).drop("_inner", "_carry")


def previous(
    df: DataFrame, by: list[str], block: str, order: str, value: str, out: str
) -> DataFrame:
    """``out``: ``value`` of the row before, NULL for a group's first row."""
    here = Window.partitionBy(*by, block).orderBy(order)
    boxed = F.struct(F.col(value).alias("v"))
    marked = df.withColumn("_prev", F.lag(boxed).over(here))
    carry = _inherited(df, by, block, order, boxed)
    return marked.join(carry, [*by, block], "left").withColumn(
        out, F.coalesce("_prev", "_carry")["v"]
    ).drop("_prev", "_carry")
