"""Streaming ingest: micro-batches of records resolved against what earlier batches stored.

State is an append-only log of deltas, one directory per batch id, so a retried batch
overwrites its own output and nothing is rewritten as the catalog grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.functions.ranking import best_row
from citegraph.operators.identity import ALIAS_KEY, resolve_identity, resolve_live

ALIAS_SCHEMA = "scheme string, value string, canonical_id string, batch bigint"
REDIRECT_SCHEMA = "canonical_id string, merged_into string, batch bigint"
RECORD_SCHEMA = "record_id string, canonical_id string, batch bigint"


def _log(spark: SparkSession, root: str, table: str, schema: str, before: int | None = None) -> DataFrame:
    """All deltas of a table, or those of batches before `before` (a retried batch must not see its own output)."""
    names = [part.split()[0] for part in schema.split(", ")]
    try:
        found = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return (found if before is None else found.where(F.col("batch") < before)).select(*names)


def _append(df: DataFrame, root: str, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch}")


def _live_map(redirects: DataFrame) -> DataFrame:
    """(canonical_id, live_id) of every id that was ever redirected; the newest redirect of an id counts."""
    newest = best_row(redirects, ["canonical_id"], [F.desc("batch"), "merged_into"]).select("canonical_id", "merged_into")
    return resolve_live(newest)


def ingest_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Resolve one batch of (record_id, seq, scheme, value) and append its deltas."""
    spark = batch.sparkSession
    if batch.isEmpty():  # a batch without data also fires when a watermark moves
        return
    keys = batch.select(*ALIAS_KEY).where(F.col("scheme").isNotNull()).distinct()
    touched = _log(spark, root, "aliases", ALIAS_SCHEMA, batch_id).join(keys, ALIAS_KEY, "left_semi")
    live = _live_map(_log(spark, root, "redirects", REDIRECT_SCHEMA, batch_id))
    known = touched.join(live, "canonical_id", "left").select(*ALIAS_KEY, F.coalesce("live_id", "canonical_id").alias("canonical_id")).distinct()
    done = resolve_identity(batch, known)
    new_aliases = done.aliases.join(known, ALIAS_KEY, "left_anti")
    _append(new_aliases, root, "aliases", batch_id)
    _append(done.redirects.select(F.col("loser_id").alias("canonical_id"), F.col("canonical_id").alias("merged_into")), root, "redirects", batch_id)
    _append(done.record_nodes, root, "records", batch_id)


def ingest_stream(records: DataFrame, root: str, checkpoint: str):
    """Start the stream: (record_id, seq, scheme, value) rows in, deltas under `root` out."""
    return (
        records.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, root))
        .trigger(availableNow=True)
        .start()
    )


def current_aliases(spark: SparkSession, root: str) -> DataFrame:
    """(scheme, value, canonical_id): every alias with its live node."""
    return _to_live(spark, root, _log(spark, root, "aliases", ALIAS_SCHEMA)).select(*ALIAS_KEY, "canonical_id").distinct()


def current_records(spark: SparkSession, root: str) -> DataFrame:
    """(record_id, canonical_id): every record with its live node."""
    return _to_live(spark, root, _log(spark, root, "records", RECORD_SCHEMA)).select("record_id", "canonical_id").distinct()


def _to_live(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    live = _live_map(_log(spark, root, "redirects", REDIRECT_SCHEMA))
    return rows.join(live, "canonical_id", "left").withColumn("canonical_id", F.coalesce("live_id", "canonical_id")).drop("live_id")
