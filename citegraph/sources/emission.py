"""What one ingest job yields: records, edges, and what could not be mapped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

EDGE_INPUT = ["src", "dst", "relation", "source", "attrs", "fetched_at"]


@dataclass
class Emission:
    """records (record_id, source, kind, aliases ARRAY<STRUCT<scheme, value>>, attrs, fetched_at);
    edges (src, dst, relation, source, attrs, fetched_at); skipped (reason, count).

    Both also get `seq`, the order in which equal claims count as written: a hash of the row's content
    where the source states no order, so a retried task numbers its rows alike.
    """

    records: DataFrame
    edges: DataFrame
    skipped: DataFrame

    def __post_init__(self) -> None:
        self.records, self.edges = with_seq(self.records), with_seq(self.edges)


def with_seq(rows: DataFrame) -> DataFrame:
    """`rows` with a `seq`; one that is there stays."""
    return rows if "seq" in rows.columns else rows.withColumn("seq", F.xxhash64(F.to_json(F.struct(*rows.columns))))


def present(entries: list[Column]) -> Column:
    """The aliases that have a value, in the order given."""
    return F.filter(F.array(*entries), lambda a: a["value"].isNotNull())


def record_aliases(records: DataFrame) -> DataFrame:
    """(record_id, seq, scheme, value), the form `resolve_identity` takes; records without aliases keep one null row."""
    return records.select("record_id", "seq", F.explode_outer("aliases").alias("a")).select(
        "record_id", "seq", F.col("a.scheme").alias("scheme"), F.col("a.value").alias("value")
    )


def doi_edges(pairs: DataFrame, source: str, fetched_at: str) -> DataFrame:
    """`cites` edges from (citing, cited) DOI pairs."""
    doi = lambda c: F.struct(F.lit("doi").alias("scheme"), F.col(c).alias("value"))
    return pairs.select(
        doi("citing").alias("src"), doi("cited").alias("dst"), F.lit("cites").alias("relation"), F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("attrs"), F.lit(fetched_at).alias("fetched_at"),
    )
