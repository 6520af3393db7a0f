"""Picking rows per key without gathering the key's rows in one task.

`best_row` filters a `row_number` to 1. Spark plans that as a *partial* group
limit before the shuffle, so a key holding a third of the table sends one row
per map task, not the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def _columns(exprs: Sequence[str | Column]) -> list[Column]:
    return [F.col(e) if isinstance(e, str) else e for e in exprs]


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first `n` rows of each key in `order` (which must end in a unique column)."""
    window = W.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in `order`."""
    return first_rows(df, keys, order, 1)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str
) -> DataFrame:
    """Add `name`: the sum of `value` over this and all earlier rows of the key, without one task per key.

    Rows are range-partitioned on (keys, order), so a hot key is spread over many
    partitions and each holds one contiguous stretch of it. Sums inside a
    stretch come from a window on (keys, stretch). A stretch then only needs the
    total of its key's earlier stretches: at most one key straddles any
    partition boundary, so that offset table has fewer than two rows per partition
    and its broadcast is bounded by the partition count, not by the data.

    The range-partitioned rows are written out first: partition numbers must
    not change if a stage is run again.
    """
    from citegraph.session import cut_lineage

    spread = cut_lineage(
        df.repartitionByRange(*_columns(keys), *_columns(order))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_value", value.cast("long"))
    )
    local = W.partitionBy(*keys, "_part").orderBy(*_columns(order)).rowsBetween(W.unboundedPreceding, 0)
    summed = spread.withColumn("_local", F.sum("_value").over(local))
    totals = spread.groupBy(*keys, "_part").agg(F.sum("_value").alias("_total"))
    prior = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_offset", F.sum("_total").over(prior))
        .where(F.col("_offset").isNotNull())
        .drop("_total")
    )
    return (
        summed.join(F.broadcast(offsets), [*keys, "_part"], "left")
        .withColumn(name, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .drop("_part", "_value", "_local", "_offset")
    )


def order_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Number *all* rows of each key from 1, in `order` (which must end in a unique column)."""
    return running_total(df, keys, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


#: Up to this many rows a global top-k may meet in one task; beyond, it is ranked in stretches.
SMALL_LIMIT = 10_000


def smallest_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first `n` rows of the whole table in `order` (which must end in a unique column)."""
    if n <= SMALL_LIMIT:
        return df.orderBy(*_columns(order)).limit(n)
    return order_rows(df, [], order, "_nth").where(F.col("_nth") <= n).drop("_nth")
