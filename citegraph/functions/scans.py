"""Ordered scans over a dense integer position (page or line numbers).

A plain window partitioned by document puts a whole document in one task. Here
each document is cut into blocks of `BLOCK` positions: the window runs inside a
block, and what one block must know about the earlier ones (a running total, the
last value seen) is a one-row-per-block summary, scanned per document and joined
back on (document, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

BLOCK = 8192


def _block(position: str, block: int) -> Column:
    return F.floor(F.col(position) / F.lit(block)).cast("long")


def running_sum(df: DataFrame, key: str, position: str, value: Column, name: str, block: int = BLOCK, total: str | None = None) -> DataFrame:
    """Add `name`: the sum of `value` over this and all earlier positions of `key`; and `total`, if named, its sum over the key."""
    inside = W.partitionBy(key, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = df.withColumn("_block", _block(position, block)).withColumn("_value", value.cast("long"))
    totals = blocks.groupBy(key, "_block").agg(F.sum("_value").alias("_total"))
    carried = totals.withColumn("_carry", F.sum("_total").over(before))
    if total is not None:
        carried = carried.withColumn(total, F.sum("_total").over(W.partitionBy(key)))
    return (
        blocks.withColumn("_sum", F.sum("_value").over(inside))
        .join(carried.drop("_total"), [key, "_block"], "left")
        .withColumn(name, F.coalesce("_sum", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop("_block", "_value", "_sum", "_carry")
    )


def carry_last(df: DataFrame, key: str, position: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Add `name`: the last non-null `value` at or before this position of `key` (an as-of fill)."""
    inside = W.partitionBy(key, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = df.withColumn("_block", _block(position, block)).withColumn("_value", value)
    ends = blocks.groupBy(key, "_block").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(position))).alias("_end")
    )
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return (
        blocks.withColumn("_here", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [key, "_block"], "left")
        .withColumn(name, F.coalesce("_here", "_carry"))
        .drop("_block", "_value", "_here", "_carry")
    )


def previous_row(df: DataFrame, key: str, position: str, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Add `prev_<column>` from position - 1, or null where that position is missing.

    The last position of a block is also sent to the next block, so no join is needed.
    """
    pos = F.col(position)
    homes = F.array(_block(position, block))
    last = pos % F.lit(block) == F.lit(block - 1)
    homes = F.when(last, F.array(_block(position, block), _block(position, block) + 1)).otherwise(homes)
    spread = df.withColumn("_home", _block(position, block)).withColumn("_block", F.explode(homes))
    window = W.partitionBy(key, "_block").orderBy(position)
    adjacent = F.lag(position).over(window) == pos - 1
    out = spread
    for column in columns:
        out = out.withColumn(f"prev_{column}", F.when(adjacent, F.lag(column).over(window)))
    return out.where(F.col("_home") == F.col("_block")).drop("_home", "_block")
