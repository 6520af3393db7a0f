"""A burst of changes becomes one signal once it has been quiet for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citegraph.functions.scans import previous_row, running_sum

QUIET_MILLIS = 400


def coalesce_changes(changes: DataFrame, quiet_millis: int = QUIET_MILLIS) -> DataFrame:
    """(key, first_ts, last_ts, changes) bursts of a bounded table (key, ts).

    Changes are first combined per key and slot of the quiet length: those of one slot always
    belong together, and the change before a slot's first is within reach only if it lies in the
    slot before. Slots, not changes, are then scanned, in blocks.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    quiet = quiet_millis * 1000
    slots = changes.select("key", micros.alias("us")).groupBy("key", F.floor(F.col("us") / quiet).alias("slot")).agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n")
    )
    chained = previous_row(slots, "key", "slot", ["last"])
    begins = F.when(F.col("prev_last").isNull() | (F.col("first") - F.col("prev_last") > quiet), 1).otherwise(0)
    bursts = running_sum(chained, "key", "slot", begins, "burst")
    return bursts.groupBy("key", "burst").agg(
        F.timestamp_micros(F.min("first")).alias("first_ts"), F.timestamp_micros(F.max("last")).alias("last_ts"),
        F.sum("n").alias("changes"),
    ).drop("burst")


def coalesce_stream(changes: DataFrame, quiet: str = "400 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """The same on a stream (key, ts TIMESTAMP): one row per burst, emitted when the watermark has passed it."""
    return (
        changes.withWatermark("ts", lateness)
        .groupBy("key", F.session_window("ts", quiet).alias("burst"))
        .agg(F.count(F.lit(1)).alias("changes"), F.max("ts").alias("last_ts"))
        .select("key", F.col("burst.start").alias("first_ts"), "last_ts", "changes")
    )
