"""What to read next: nodes near a selection, by the share of its mass that reaches them.

Every selected node starts with `UNIT`. In each round a node keeps what it has but `SPREAD` per cent, which it deals evenly to
the ends of its edges; what does not divide evenly stays too. All mass is whole numbers, so none is lost or made, at hubs
neither, and the order of additions does not matter. Only nodes with mass are rows, so a round reads the edges of those
that were reached; a hub is one row on its side of the join, and what reaches a node is added up before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from citegraph.functions.ranking import smallest_rows
from citegraph.operators.graph import _ends
from citegraph.session import broadcast_if_small, cut_lineage, measure

UNIT, SPREAD, ROUNDS = 10**12, 85, 3


def steps_of(edges: DataFrame, direction: str = "forward") -> Callable[[DataFrame, int], DataFrame]:
    """`leaving` of `spread_mass` over an edge table; `adjacency.Adjacency.at` gives the same from a layout."""
    near, _ = _ends(direction)

    def leaving(frontier: DataFrame, size: int) -> DataFrame:
        side = frontier.select(F.col("canonical_id").alias(near))
        return edges.join(broadcast_if_small(side, size), near, "left_semi")

    return leaving


def spread_mass(leaving: Callable[[DataFrame, int], DataFrame], seeds: DataFrame, direction: str = "forward", rounds: int = ROUNDS) -> DataFrame:
    """(canonical_id, mass) after the rounds. Edges between the same two nodes count once; a node may lead to itself."""
    near, far = _ends(direction)
    state = cut_lineage(seeds.select("canonical_id").distinct().withColumn("mass", F.lit(UNIT).cast("long")))
    walked, steps, degree = None, None, None
    for _ in range(rounds):
        # A node that was reached stays a row of the state, so only new ones have their edges read.
        fresh = state.select("canonical_id")
        fresh = fresh if walked is None else cut_lineage(fresh.join(walked.select("canonical_id"), "canonical_id", "left_anti"))
        size = measure(fresh, "canonical_id")[1]
        more = cut_lineage(leaving(fresh, size).select(F.col(near).alias("canonical_id"), F.col(far).alias("to")).distinct())
        ends = cut_lineage(more.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")))
        steps, degree = (more, ends) if walked is None else (steps.unionByName(more), degree.unionByName(ends))
        walked = state
        part = F.expr(f"(mass div 100 * {SPREAD} + mass % 100 * {SPREAD} div 100) div n")
        rated = cut_lineage(state.join(degree, "canonical_id", "left").withColumn("part", F.coalesce(part, F.lit(0).cast("long"))))
        kept = rated.select("canonical_id", (F.col("mass") - F.coalesce("n", F.lit(0)) * F.col("part")).alias("mass"))
        sent = steps.join(rated.where("part > 0").select("canonical_id", "part"), "canonical_id").select(F.col("to").alias("canonical_id"), F.col("part").alias("mass"))
        state = cut_lineage(kept.unionByName(sent).groupBy("canonical_id").agg(F.sum("mass").alias("mass")))
    return state


def proposals(
    leaving: Callable[[DataFrame, int], DataFrame], seeds: DataFrame, budget: int, direction: str = "forward", rounds: int = ROUNDS
) -> DataFrame:
    """(canonical_id, mass): the `budget` nodes outside the selection that most mass reached; ties by the smaller id."""
    reached = spread_mass(leaving, seeds, direction, rounds).join(seeds.select("canonical_id"), "canonical_id", "left_anti")
    return smallest_rows(reached.where("mass > 0"), [F.desc("mass"), "canonical_id"], budget)
