"""Interval-overlap join on (key, bin) instead of key alone.

A join on the document alone compares every pair of intervals of a hot document
in one task. Cutting the axis into bins spreads the document and keeps only near
pairs; a pair that meets in several bins is kept in the first one they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int = 64,
) -> DataFrame:
    """Inner join where keys match and the closed intervals share a point. Inverted intervals match nothing."""
    (ls, le), (rs, re) = left_span, right_span
    lefts = left.where(F.col(ls) <= F.col(le)).withColumn("_bin", F.explode(_bins(F.col(ls), F.col(le), width)))
    rights = right.where(F.col(rs) <= F.col(re)).withColumn("_bin", F.explode(_bins(F.col(rs), F.col(re), width)))
    first_shared = F.floor(F.greatest(F.col(ls), F.col(rs)) / width).cast("long")
    return (
        lefts.join(rights, [key, "_bin"])
        .where((F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs)) & (F.col("_bin") == first_shared))
        .drop("_bin")
    )
