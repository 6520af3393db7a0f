"""Edges laid out by their ends, so that a step of a walk reads the edges of its nodes and few others.

Every edge lies twice, by source and by target, in parts by a hash of that end (`streaming.ledger`). A hop looks up
its frontier: it reads the parts those nodes fall into, whatever the size of the graph. New edges are added as
further batches; runs are merged as they are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.functions.ranking import first_rows
from citegraph.operators import graph
from citegraph.operators.graph import EDGE_KEY, Neighborhood
from citegraph.streaming.ledger import FAN, PART_ROWS, Layout, Ledger

_SCHEMA = "src_id string, dst_id string, relation string"
LAYOUTS = (Layout("edges_out", _SCHEMA, tuple(EDGE_KEY), ("src_id",)), Layout("edges_in", _SCHEMA, tuple(EDGE_KEY), ("dst_id",)))


class Adjacency:
    """A graph under `root`; `add` writes edges, the rest reads them."""

    def __init__(self, spark: SparkSession, root: str, part_rows: int = PART_ROWS, fan: int = FAN) -> None:
        self.ledger = Ledger(spark, root, LAYOUTS, part_rows, fan)

    def add(self, edges: DataFrame) -> None:
        """Add edges (src_id, dst_id, relation); those that are there already stay one edge."""
        rows = edges.select(*EDGE_KEY).distinct().withColumn("gone", F.lit(False))
        if self.ledger.commit(self.ledger.manifest().batch + 1, {"edges_out": rows, "edges_in": rows}):
            self.ledger.compact()

    def at(self, ids: DataFrame, direction: str = "forward") -> DataFrame:
        """The edges that leave (or enter) the nodes of `ids` (canonical_id)."""
        near, table = ("src_id", "edges_out") if direction == "forward" else ("dst_id", "edges_in")
        return self.ledger.lookup(table, ids.select(F.col("canonical_id").alias(near)))

    def edges_of(self, ids: DataFrame, direction: str = "forward", limit: int | None = None) -> DataFrame:
        """As `graph.edges_of`."""
        near, far = graph._ends(direction)
        found = self.at(ids, direction)
        if limit is None:
            return found
        totals = found.groupBy(near).agg(F.count(F.lit(1)).alias("total"))
        return first_rows(found, [near], [far, "relation"], limit).join(totals, near).select(*EDGE_KEY, "total")

    def neighborhood(
        self, seeds: DataFrame, direction: str = "forward", depth: int = 1, max_nodes: int | None = 200, nodes: DataFrame | None = None
    ) -> Neighborhood:
        """As `graph.neighborhood`."""
        graph._ends(direction)
        return graph.walk(lambda frontier, _: self.at(frontier, direction), seeds, direction, depth, max_nodes, nodes)
