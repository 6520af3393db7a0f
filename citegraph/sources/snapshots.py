"""Export snapshots and publishing them: a fresh directory per snapshot, a pointer switched last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A node's nested arrays are split into parts of about this many entries.
PART_ENTRIES = 10_000


def export_nodes(nodes: DataFrame, aliases: DataFrame, assertions: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Live nodes with nested aliases and assertions: (canonical_id, kind, part, aliases, assertions).

    Each child table is gathered per node before the join. A node with more than `part_entries`
    children is spread over several rows (`part` 0, 1, …), so no row or task has to hold all
    children of a welded node; part 0 always exists.
    """
    live = nodes.where(F.col("merged_into").isNull()).select("canonical_id", "kind")

    def gathered(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        sizes = df.groupBy("canonical_id").agg(F.ceil(F.count(F.lit(1)) / part_entries).cast("int").alias("_parts"))
        large = sizes.where(F.col("_parts") > 1)
        split = df.join(large, "canonical_id", "left").withColumn(
            "part", F.coalesce(F.pmod(F.xxhash64(*fields), F.col("_parts")), F.lit(0)).cast("int")
        )
        return split.groupBy("canonical_id", "part").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    named = gathered(aliases, "aliases", ["scheme", "value"])
    claimed = gathered(assertions, "assertions", ["source", "fetched_at", "attrs"])
    children = named.join(claimed, ["canonical_id", "part"], "full")
    return live.join(children, "canonical_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def export_flat(nodes: DataFrame, aliases: DataFrame, assertions: DataFrame) -> dict[str, DataFrame]:
    """Live nodes and, as rows of their own, their aliases and assertions: the same shape however many a node has.

    Each table is range-partitioned and sorted by its key, so that a reader joins them by merging and prunes by id.
    """
    live = nodes.where(F.col("merged_into").isNull()).select("canonical_id", "kind")
    of_live = lambda table, *columns: table.select("canonical_id", *columns).join(live.select("canonical_id"), "canonical_id", "left_semi")
    laid = lambda table, *key: table.repartitionByRange(*key).sortWithinPartitions(*key)
    return {
        "nodes": laid(live, "canonical_id"),
        "aliases": laid(of_live(aliases, "scheme", "value"), "canonical_id", "scheme", "value"),
        "assertions": laid(of_live(assertions, "source", "fetched_at", "attrs"), "canonical_id", "source"),
    }


def export_edge_assertions(edge_assertions: DataFrame) -> DataFrame:
    """Every edge assertion, range-partitioned and sorted by its key for pruned reads."""
    key = ["src_id", "dst_id", "relation", "source"]
    return edge_assertions.repartitionByRange(*key).sortWithinPartitions(*key)


def export_artifacts(artifacts: DataFrame) -> DataFrame:
    """Current artifacts, range-partitioned and sorted by (canonical_id, role)."""
    key = ["canonical_id", "role"]
    return artifacts.where("is_current").repartitionByRange(*key).sortWithinPartitions(*key)


def publish(df: DataFrame, root: str, table: str, snapshot: str) -> str:
    """Write `df` as one snapshot of `table` and return its path.

    The path is a function of the snapshot name, so a retried write replaces its own output.
    """
    path = f"{root}/{table}/snapshot={snapshot}"
    df.write.mode("overwrite").parquet(path)
    return path


def set_current(spark: SparkSession, root: str, table: str, snapshot: str) -> None:
    """Switch the pointer of `table` to `snapshot`, after all its files are in place."""
    spark.createDataFrame([(snapshot,)], "snapshot string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}/_current")


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    snapshot = spark.read.parquet(f"{root}/{table}/_current").first()["snapshot"]
    return spark.read.parquet(f"{root}/{table}/snapshot={snapshot}")
