"""Latest assertion per (node, provider) under out-of-order arrival, as keyed state.

The state is one row per key, in a `Ledger` whose parts are found by the node. A batch looks up only its own keys, and writes
only the rows that are newer than what is held: a late or repeated row leaves nothing behind. Merges of
runs drop the versions that were replaced meanwhile, so the state holds a bounded number of versions of a key
(less than `fan` per level), and one after a merge of all runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.functions.ranking import best_row
from citegraph.streaming.ledger import FAN, PART_ROWS, Layout, Ledger

KEY = ["canonical_id", "source"]
LATEST = Layout("latest", "canonical_id string, source string, attrs string, fetched_at string", tuple(KEY), ("canonical_id",))


def open_state(spark: SparkSession, root: str, part_rows: int = PART_ROWS, fan: int = FAN) -> Ledger:
    return Ledger(spark, root, [LATEST], part_rows, fan)


def latest_batch(batch: DataFrame, batch_id: int, state: Ledger) -> None:
    """Commit the batch's rows that are newer than the state; a batch that comes again is passed over.

    Newest is by stated time; equal times are settled by content, so arrival order never matters.
    """
    if batch.isEmpty() or batch_id <= state.manifest().batch:
        return
    order = [F.desc("fetched_at"), F.desc("attrs")]
    own = best_row(batch.select(*LATEST.columns), KEY, order)
    held = state.lookup("latest", own).withColumn("held", F.lit(1))
    fresh = best_row(held.unionByName(own.withColumn("held", F.lit(0))), KEY, [*order, F.desc("held")]).where("held = 0")
    if state.commit(batch_id, {"latest": fresh.select(*LATEST.columns, F.lit(False).alias("gone"))}):
        state.compact()


def latest_stream(assertions: DataFrame, state: Ledger, checkpoint: str):
    return (
        assertions.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: latest_batch(batch, batch_id, state))
        .trigger(availableNow=True)
        .start()
    )


def current_state(state: Ledger) -> DataFrame:
    """(canonical_id, source, attrs, fetched_at): a late row loses by its time, whenever it came."""
    return state.read("latest")
