"""The citation graph: edge claims, edges of a node, bounded neighbourhoods, rankings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.functions.ranking import best_row, first_rows, smallest_rows
from citegraph.session import broadcast_if_small, cut_lineage, measure

EDGE_KEY = ["src_id", "dst_id", "relation"]


def edge_assertions(claims: DataFrame) -> DataFrame:
    """Last write per (edge, provider); `seq` orders the writes."""
    latest = best_row(claims, [*EDGE_KEY, "source"], [F.desc("seq")])
    return latest.select(*EDGE_KEY, "source", "fetched_at", "attrs")


def distinct_edges(claims: DataFrame) -> DataFrame:
    """One row per (src, dst, relation), however many providers assert it."""
    return claims.select(*EDGE_KEY).distinct()


def edges_with_sources(assertions: DataFrame) -> DataFrame:
    """One row per edge with its assertions nested.

    Expects `edge_assertions` output, so the array holds one entry per provider.
    """
    entry = F.struct("source", "fetched_at", "attrs")
    return assertions.groupBy(*EDGE_KEY).agg(F.array_sort(F.collect_list(entry)).alias("assertions"))


@dataclass
class EdgeWrite:
    """Result of `put_edges`: claims on node ids, the stubs they need, and the input count."""

    claims: DataFrame
    stub_nodes: DataFrame
    stub_aliases: DataFrame
    counted: DataFrame


def stub_nodes(stub_aliases: DataFrame) -> DataFrame:
    """The `work` nodes of stub aliases."""
    return stub_aliases.select("canonical_id", F.lit("work").alias("kind"), F.lit(None).cast("string").alias("merged_into")).distinct()


def put_edges(edge_inputs: DataFrame, live_aliases: DataFrame) -> EdgeWrite:
    """Resolve both ends of each edge to live nodes; an unknown end becomes a `work` stub.

    `edge_inputs`: src/dst STRUCT<scheme,value>, relation, source, attrs, fetched_at, seq.
    `live_aliases`: (scheme, value, canonical_id) already pointing at live nodes.
    """
    from citegraph.operators.identity import minted_id

    stub = lambda end: minted_id(F.concat_ws(":", F.col(f"{end}.scheme"), F.col(f"{end}.value")))
    known = live_aliases.select("scheme", "value", "canonical_id")
    out = edge_inputs
    for end in ("src", "dst"):
        side = known.select(
            F.col("scheme").alias(f"_{end}_s"), F.col("value").alias(f"_{end}_v"), F.col("canonical_id").alias(f"_{end}_known")
        )
        out = out.join(
            side, (F.col(f"{end}.scheme") == F.col(f"_{end}_s")) & (F.col(f"{end}.value") == F.col(f"_{end}_v")), "left"
        ).withColumn(f"{end}_id", F.coalesce(f"_{end}_known", stub(end)))
    # Ends are made distinct before the shuffle and then looked up; the edges themselves are not joined again for them.
    ends = edge_inputs.select(F.explode(F.array(*[F.struct(f"{end}.scheme", f"{end}.value") for end in ("src", "dst")])).alias("e")).select("e.*").distinct()
    stubs = ends.join(known.where(F.col("canonical_id").isNotNull()), ["scheme", "value"], "left_anti").select(
        "scheme", "value", minted_id(F.concat_ws(":", "scheme", "value")).alias("canonical_id")
    )
    return EdgeWrite(
        claims=out.select(*EDGE_KEY, "source", "fetched_at", "attrs", "seq"),
        stub_nodes=stub_nodes(stubs),
        stub_aliases=stubs,
        counted=edge_inputs.agg(F.count(F.lit(1)).alias("written")),
    )


def _ends(direction: str) -> tuple[str, str]:
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be 'forward' or 'backward', not {direction!r}")
    return ("src_id", "dst_id") if direction == "forward" else ("dst_id", "src_id")


def edges_of(edges: DataFrame, ids: DataFrame, direction: str = "forward", limit: int | None = None) -> DataFrame:
    """Edges leaving (or entering) each requested node.

    With a `limit` the first by (other end, relation) are kept, and `total` says how many the node has.
    """
    near, far = _ends(direction)
    wanted = edges.join(ids.select(F.col("canonical_id").alias(near)).distinct(), near, "left_semi")
    if limit is None:
        return wanted
    totals = wanted.groupBy(near).agg(F.count(F.lit(1)).alias("total"))
    return first_rows(wanted, [near], [far, "relation"], limit).join(totals, near).select(*edges.columns, "total")


@dataclass
class Neighborhood:
    """`nodes` (canonical_id, depth, in_degree), `edges` closed over them, and whether the cap cut it."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def neighborhood(
    edges: DataFrame,
    seeds: DataFrame,
    direction: str = "forward",
    depth: int = 1,
    max_nodes: int | None = 200,
    nodes: DataFrame | None = None,
) -> Neighborhood:
    """Bounded breadth-first walk from `seeds` (canonical_id) over an edge table: see `walk`. One join per hop."""
    near, _ = _ends(direction)

    def leaving(frontier: DataFrame, size: int) -> DataFrame:
        side = frontier.select(F.col("canonical_id").alias(near))
        return edges.select(*EDGE_KEY).join(broadcast_if_small(side, size), near, "left_semi")

    return walk(leaving, seeds, direction, depth, max_nodes, nodes)


def walk(
    leaving: Callable[[DataFrame, int], DataFrame],
    seeds: DataFrame,
    direction: str = "forward",
    depth: int = 1,
    max_nodes: int | None = 200,
    nodes: DataFrame | None = None,
) -> Neighborhood:
    """Bounded breadth-first walk, closed and ranked by in-degree.

    `leaving(frontier, bytes)` gives the edges at the frontier's nodes (canonical_id). Each hop's edges are written once;
    the driver sees one count per hop. Where the cap bites, the smallest ids of that hop are kept. Seeds that are not
    among `nodes` (canonical_id), if given, are skipped.
    An edge is in the closed subgraph when its near end was expanded (depth below the limit) and its far end was
    visited: each node is expanded in one hop, so those are the hops' edges with a visited far end.
    """
    near, far = _ends(direction)
    truncated, hops = False, []
    known = seeds if nodes is None else seeds.join(nodes.select("canonical_id"), "canonical_id", "left_semi")
    visited = cut_lineage(known.select("canonical_id").distinct().withColumn("depth", F.lit(0)))
    total, size = measure(visited, "canonical_id")
    if max_nodes is not None and total > max_nodes:
        visited, truncated = cut_lineage(smallest_rows(visited, ["canonical_id"], max_nodes)), True
        total, size = measure(visited, "canonical_id")
    fresh, fresh_size = total, size
    for hop in range(depth):
        if fresh == 0:
            break
        frontier = visited.where(F.col("depth") == hop).select("canonical_id")
        reached = cut_lineage(leaving(frontier, fresh_size).select(*EDGE_KEY))
        hops.append(reached)
        new = reached.select(F.col(far).alias("canonical_id")).distinct().join(
            broadcast_if_small(visited.select("canonical_id"), size), "canonical_id", "left_anti"
        )
        new = cut_lineage(new)
        fresh, fresh_size = measure(new, "canonical_id")
        if max_nodes is not None and total + fresh > max_nodes:
            room, truncated = max_nodes - total, True
            new = cut_lineage(smallest_rows(new, ["canonical_id"], room))
            fresh, fresh_size = measure(new, "canonical_id")
        total, size = total + fresh, size + fresh_size
        visited = visited.unionByName(new.withColumn("depth", F.lit(hop + 1)))

    inside = broadcast_if_small(visited.select(F.col("canonical_id").alias(far)), size)
    closed = reduce(DataFrame.unionByName, hops).join(inside, far, "left_semi").select(*EDGE_KEY) if hops else _no_edges(visited)
    return Neighborhood(nodes=rank_by_in_degree(visited, closed), edges=closed, truncated=truncated)


def _no_edges(visited: DataFrame) -> DataFrame:
    return visited.select(*[F.col("canonical_id").alias(c) for c in EDGE_KEY]).limit(0)


def describe(ranked_nodes: DataFrame, nodes: DataFrame, assertions: DataFrame) -> DataFrame:
    """A walk's nodes with `kind` and what their providers state, merged: (..., kind, attrs, provenance).

    Only the claims of visited nodes are parsed; a node without claims has null maps.
    """
    from citegraph.operators.catalog import merge_assertions, nest_fields

    stated = assertions.join(ranked_nodes.select("canonical_id"), "canonical_id", "left_semi")
    kinds = nodes.select("canonical_id", "kind")
    return ranked_nodes.join(kinds, "canonical_id", "left").join(nest_fields(merge_assertions(stated)), "canonical_id", "left")


def rank_by_in_degree(nodes: DataFrame, closed_edges: DataFrame) -> DataFrame:
    """`nodes` plus `in_degree` over `closed_edges`, zeros kept. Sort by in_degree desc, id asc to rank."""
    degree = closed_edges.groupBy(F.col("dst_id").alias("canonical_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(degree, "canonical_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long")))


def ranked(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.desc("in_degree"), F.asc("canonical_id"))


def cited_by(edges: DataFrame, works: DataFrame, requests: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Works citing each requested one: (canonical_id asked for, citing row of `works`).

    `concepts` (canonical_id, concept) with a `concept` column on `requests` keeps only
    citing works of that concept, which stops a walk drifting out of its field.
    """
    citing = edges.join(requests.withColumnRenamed("canonical_id", "dst_id"), "dst_id")
    if concepts is not None:
        citing = citing.join(concepts.withColumnRenamed("canonical_id", "src_id"), ["src_id", "concept"], "left_semi")
    citing = citing.select(F.col("dst_id").alias("requested_id"), F.col("src_id").alias("canonical_id")).distinct()
    return citing.join(works, "canonical_id")


def references(edges: DataFrame, works: DataFrame, requests: DataFrame) -> DataFrame:
    """Works each requested one cites."""
    cited = edges.join(requests.withColumnRenamed("canonical_id", "src_id"), "src_id")
    cited = cited.select(F.col("src_id").alias("requested_id"), F.col("dst_id").alias("canonical_id")).distinct()
    return cited.join(works, "canonical_id")


def field_canon(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """In-degree of every work inside the subgraph of each concept: (concept, canonical_id, in_degree).

    An edge counts for a concept only where both ends carry it. A hub is one key of the
    aggregation, which is combined on the map side first.
    """
    tagged = concepts.select("canonical_id", "concept").distinct()
    src = tagged.select(F.col("canonical_id").alias("src_id"), "concept")
    dst = tagged.select(F.col("canonical_id").alias("dst_id"), "concept")
    inside = edges.select(*EDGE_KEY).join(src, "src_id").join(dst, ["dst_id", "concept"], "left_semi")
    degree = inside.groupBy("concept", F.col("dst_id").alias("canonical_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return tagged.join(degree, ["concept", "canonical_id"], "left").withColumn(
        "in_degree", F.coalesce("in_degree", F.lit(0).cast("long"))
    )


def canon_order() -> list[Column]:
    return [F.desc("in_degree"), F.asc("canonical_id")]
