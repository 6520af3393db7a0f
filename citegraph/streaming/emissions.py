"""Whole emissions from a stream: records and edges become nodes, aliases, claims and edges, batch by batch.

A batch is what `store_sync.apply_emission` makes of it, on that part of the store it can touch: the nodes of the
aliases it names, and where nodes merge, the claims, aliases and edges of those. Only these are looked up, and only what
changed is written, for all tables in one commit (`Ledger`). So the work of a batch goes with the batch and
with the nodes it merges, not with the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.operators.graph import EDGE_KEY
from citegraph.operators.identity import ALIAS_KEY, Resolution, alias_text, minted_id, resolve_identity, resolve_live
from citegraph.operators.store_sync import Store, write_resolved
from citegraph.session import cut_lineage
from citegraph.sources.emission import Emission, record_aliases
from citegraph.streaming.ledger import FAN, PART_ROWS, Layout, Ledger

_EDGE = "src_id string, dst_id string, relation string, source string, fetched_at string, attrs string"
_ALIAS = "scheme string, value string, canonical_id string"
LAYOUTS = (
    Layout("nodes", "canonical_id string, kind string, merged_into string", ("canonical_id",), ("canonical_id",)),
    Layout("aliases", _ALIAS, ("scheme", "value"), ("scheme", "value")),
    Layout("held", _ALIAS, ("canonical_id", "scheme", "value"), ("canonical_id",)),  # the same aliases, by node
    Layout("assertions", "canonical_id string, source string, attrs string, fetched_at string", ("canonical_id", "source"), ("canonical_id",)),
    Layout("edges_out", _EDGE, (*EDGE_KEY, "source"), ("src_id",)),
    Layout("edges_in", _EDGE, (*EDGE_KEY, "source"), ("dst_id",)),
    Layout("records", "record_id string, canonical_id string", ("record_id",), ("record_id",)),
)
ARTIFACTS = "canonical_id string, role string, version int, is_current boolean, derived_from_role string, derived_from_version int"
_END = "STRUCT<scheme: STRING, value: STRING>"
#: A row of the stream is a record or an edge; the other is null.
ROW = (
    f"record STRUCT<record_id: STRING, source: STRING, kind: STRING, aliases: ARRAY<{_END}>, attrs: STRING, fetched_at: STRING, seq: BIGINT>, "
    f"edge STRUCT<src: {_END}, dst: {_END}, relation: STRING, source: STRING, attrs: STRING, fetched_at: STRING, seq: BIGINT>"
)
_RECORD, _EDGE_ROW = ("record_id", "source", "kind", "aliases", "attrs", "fetched_at", "seq"), ("src", "dst", "relation", "source", "attrs", "fetched_at", "seq")


def stream_rows(emission: Emission) -> DataFrame:
    """An emission as rows of one table (`ROW`), for a stream to carry."""

    def side(rows: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
        return rows.withColumn("seq", F.col("seq").cast("long")).select(F.struct(*columns).alias(name))

    records = side(emission.records, "record", _RECORD)
    edges = side(emission.edges, "edge", _EDGE_ROW)
    return records.unionByName(edges, allowMissingColumns=True).select("record", "edge")


def emission_of(rows: DataFrame) -> Emission:
    """The emission that rows of a stream (`ROW`) make up."""
    return Emission(
        records=rows.where("record IS NOT NULL").select("record.*"), edges=rows.where("edge IS NOT NULL").select("edge.*"),
        skipped=rows.sparkSession.createDataFrame([], "reason string, count long"),
    )


def open_ledger(spark: SparkSession, root: str, part_rows: int = PART_ROWS, fan: int = FAN) -> Ledger:
    return Ledger(spark, root, LAYOUTS, part_rows, fan)


def _differences(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of `new` that `old` has not, and rows of `old` (`gone`) whose key `new` has not."""
    fresh = new.select(*old.columns).subtract(old).withColumn("gone", F.lit(False))
    lost = old.join(new.select(*key), list(key), "left_anti").select(*old.columns).withColumn("gone", F.lit(True))
    return fresh.unionByName(lost)


def _touched(ledger: Ledger, records: DataFrame, edges: DataFrame, known: DataFrame, done: Resolution) -> Store:
    """The part of the store that a resolved batch reads or changes."""
    spark = ledger.spark
    losers = done.redirects.select(F.col("loser_id").alias("canonical_id")).distinct()
    merging = losers.unionByName(done.redirects.select("canonical_id")).distinct()
    stub: Column = minted_id(alias_text())
    ends = [edges.select(F.col(f"{end}.scheme").alias("scheme"), F.col(f"{end}.value").alias("value")).select(stub.alias("canonical_id")) for end in ("src", "dst")]
    ids = losers.unionByName(done.record_nodes.select("canonical_id")).unionByName(ends[0]).unionByName(ends[1])
    nodes = ledger.lookup("nodes", ids)
    none = lambda name: spark.createDataFrame([], ledger.layouts[name].schema)
    if done.redirects.isEmpty():
        return Store(nodes, known, none("assertions"), none("edges_out"), spark.createDataFrame([], ARTIFACTS))
    held = ledger.lookup("held", losers).select(*known.columns)
    leaving = ledger.lookup("edges_out", losers.select(F.col("canonical_id").alias("src_id")))
    entering = ledger.lookup("edges_in", losers.select(F.col("canonical_id").alias("dst_id")))
    moving = cut_lineage(leaving.unionByName(entering.select(*leaving.columns)).distinct())
    # What already stands where they go.
    to = done.redirects.select(F.col("loser_id"), F.col("canonical_id").alias("survivor"))
    moved = moving
    for end in ("src_id", "dst_id"):
        moved = moved.join(to.withColumnRenamed("loser_id", end), end, "left").withColumn(end, F.coalesce("survivor", end)).drop("survivor")
    there = ledger.lookup("edges_out", moved.select("src_id")).join(moved.select(*EDGE_KEY, "source").distinct(), [*EDGE_KEY, "source"], "left_semi")
    return Store(
        nodes, known.unionByName(held).distinct(), ledger.lookup("assertions", merging), moving.unionByName(there.select(*moving.columns)).distinct(),
        spark.createDataFrame([], ARTIFACTS),
    )


def ingest_emission(ledger: Ledger, batch_id: int, emission: Emission) -> bool:
    """Write one emission as one batch; False if that batch was committed before."""
    if batch_id <= ledger.manifest().batch:
        return False
    records, edges = cut_lineage(emission.records), cut_lineage(emission.edges)
    bundle = record_aliases(records)
    named = bundle.where(F.col("scheme").isNotNull()).select(*ALIAS_KEY)
    for end in ("src", "dst"):
        named = named.unionByName(edges.select(F.col(f"{end}.scheme").alias("scheme"), F.col(f"{end}.value").alias("value")))
    known = cut_lineage(ledger.lookup("aliases", named))  # aliases in the ledger name live nodes
    done = resolve_identity(bundle, known, records.select("record_id", "seq", "kind"))
    done.redirects, done.record_nodes = cut_lineage(done.redirects), cut_lineage(done.record_nodes)
    was = _touched(ledger, records, edges, known, done)
    was = Store(*[cut_lineage(t) for t in (was.nodes, was.aliases, was.assertions, was.edge_assertions, was.artifacts)])
    now = write_resolved(was, records, edges, done)
    by_node = ("canonical_id", "scheme", "value")
    claims = _differences(was.edge_assertions, now.edge_assertions, (*EDGE_KEY, "source"))
    return ledger.commit(
        batch_id,
        {
            "nodes": _differences(was.nodes, now.nodes, ("canonical_id",)), "aliases": _differences(was.aliases, now.aliases, ("scheme", "value")),
            "held": _differences(was.aliases, now.aliases, by_node), "assertions": _differences(was.assertions, now.assertions, ("canonical_id", "source")),
            "edges_out": claims, "edges_in": claims, "records": done.record_nodes.withColumn("gone", F.lit(False)),
        },
    )


def ingest_batch(batch: DataFrame, batch_id: int, ledger: Ledger) -> None:
    """One micro-batch of `ROW`s. One without rows (they also come when a watermark moves) leaves the ledger as it is."""
    if not batch.isEmpty() and ingest_emission(ledger, batch_id, emission_of(batch)):
        ledger.compact()


def emission_stream(rows: DataFrame, ledger: Ledger, checkpoint: str):
    """Start the stream: `ROW`s in, committed batches in the ledger out."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, ledger))
        .trigger(availableNow=True)
        .start()
    )


def current_store(ledger: Ledger) -> Store:
    """The store as of the last committed batch; artifacts are no part of an emission."""
    return Store(
        ledger.read("nodes"), ledger.read("aliases"), ledger.read("assertions"), ledger.read("edges_out"), ledger.spark.createDataFrame([], ARTIFACTS)
    )


def current_records(ledger: Ledger) -> DataFrame:
    """(record_id, canonical_id): every record with its live node."""
    live = resolve_live(ledger.read("nodes"))
    return ledger.read("records").join(live, "canonical_id", "left").select("record_id", F.coalesce("live_id", "canonical_id").alias("canonical_id"))
