"""Comparing, synchronising and pruning stores.

A store is a set of tables: nodes (canonical_id, kind, merged_into), aliases (scheme, value,
canonical_id), assertions, edge assertions and artifacts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from citegraph.operators import graph, identity
from citegraph.operators.catalog import stats, upsert_assertions
from citegraph.operators.identity import ALIAS_KEY, address_alias, alias_text, resolve_live
from citegraph.session import cut_lineage
from citegraph.sources.emission import Emission, record_aliases


@dataclass
class Store:
    nodes: DataFrame
    aliases: DataFrame
    assertions: DataFrame
    edge_assertions: DataFrame
    artifacts: DataFrame

    def live_nodes(self) -> DataFrame:
        return self.nodes.where(F.col("merged_into").isNull())

    def edges(self) -> DataFrame:
        return self.edge_assertions.select("src_id", "dst_id", "relation").distinct()


@dataclass
class Applied:
    """The store after an emission, and which node each record became."""

    store: Store
    record_nodes: DataFrame


def apply_emission(store: Store, emission: Emission) -> Applied:
    """Write records and edges into a store: identity, claims, merges, then edges on what is known by then.

    Every table of the result is written once. Applying the same emission again changes nothing.
    """
    records, edges = cut_lineage(emission.records), cut_lineage(emission.edges)
    live = resolve_live(store.nodes)
    known = store.aliases.join(live, "canonical_id").select(*ALIAS_KEY, F.col("live_id").alias("canonical_id"))
    done = identity.resolve_identity(record_aliases(records), known, records.select("record_id", "seq", "kind"))
    done.redirects, done.record_nodes = cut_lineage(done.redirects), cut_lineage(done.record_nodes)
    return Applied(write_resolved(store, records, edges, done), done.record_nodes)


def write_resolved(store: Store, records: DataFrame, edges: DataFrame, done: identity.Resolution) -> Store:
    """The store after records and edges whose identity is resolved. It may be a part of a store: see `streaming.emissions`."""
    redirects, record_nodes = done.redirects, done.record_nodes
    # A record without aliases mints the same id each time, so ids already there are not added again.
    held = store.nodes.select("canonical_id")
    nodes = cut_lineage(
        identity.merge_nodes(store.nodes, redirects).unionByName(
            done.new_nodes.select("canonical_id", "kind", "merged_into").join(held, "canonical_id", "left_anti")
        )
    )
    moved = identity.merge_aliases(store.aliases, redirects)
    aliases = moved.unionByName(done.aliases.select(*ALIAS_KEY, "canonical_id").join(moved.select(*ALIAS_KEY), ALIAS_KEY, "left_anti"))

    # A direct write replaces its provider's claim whatever the times; among the emission's own the last counts.
    claimed = records.join(record_nodes, "record_id").select("canonical_id", "source", "attrs", "fetched_at", "seq")
    fresh = upsert_assertions(claimed).drop("seq")
    old = identity.merge_node_assertions(store.assertions, redirects).select("canonical_id", "source", "attrs", "fetched_at")
    assertions = old.join(fresh, ["canonical_id", "source"], "left_anti").unionByName(fresh)

    aliases = cut_lineage(aliases)
    written = graph.put_edges(edges, aliases)
    old_edges = identity.merge_edge_assertions(store.edge_assertions, redirects)
    new_edges = cut_lineage(graph.edge_assertions(written.claims))
    edge_assertions = old_edges.select(*new_edges.columns).join(new_edges, [*graph.EDGE_KEY, "source"], "left_anti").unionByName(new_edges)
    stub_aliases = cut_lineage(written.stub_aliases.select(*ALIAS_KEY, "canonical_id"))
    stubs = graph.stub_nodes(stub_aliases).join(nodes.select("canonical_id"), "canonical_id", "left_anti")
    return Store(
        nodes=cut_lineage(nodes.unionByName(stubs)),
        aliases=cut_lineage(aliases.unionByName(stub_aliases)),
        assertions=cut_lineage(assertions),
        edge_assertions=cut_lineage(edge_assertions),
        artifacts=cut_lineage(identity.merge_artifacts(store.artifacts, redirects)),
    )


# ── comparison ───────────────────────────────────────────────────────────────


def presence(store: Store, other_aliases: DataFrame) -> DataFrame:
    """(canonical_id, kind, n_aliases, n_found, address): how many of a live node's aliases the other side knows.

    One row per alias is reduced to one per node on the map side; a node with very many aliases is one key.
    """
    known = other_aliases.select(*ALIAS_KEY).distinct().withColumn("_found", F.lit(1))
    counted = (
        store.aliases.join(known, ALIAS_KEY, "left")
        .groupBy("canonical_id")
        .agg(F.count(F.lit(1)).alias("n_aliases"), F.count("_found").alias("n_found"))
    )
    named = address_alias(store.aliases).select("canonical_id", alias_text().alias("address"))
    return (
        store.live_nodes()
        .select("canonical_id", "kind")
        .join(counted, "canonical_id", "left")
        .join(named, "canonical_id", "left")
        .fillna(0, ["n_aliases", "n_found"])
    )


def diff_side(store: Store, other_aliases: DataFrame, label: str) -> DataFrame:
    """(side, metric, value): nodes no alias of which the other side knows, works among them, unaddressable ones."""
    seen = presence(store, other_aliases)
    only = (F.col("n_aliases") > 0) & (F.col("n_found") == 0)
    row = seen.agg(
        F.count_if(only).alias("only_here"),
        F.count_if(only & (F.col("kind") == "work")).alias("works_only_here"),
        F.count_if(F.col("n_aliases") == 0).alias("unaddressable"),
    )
    metrics = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])
    held = store.artifacts.where("is_current").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("artifacts").alias("metric"), "value"
    )
    headline = stats(store.nodes, store.assertions, store.edges(), store.artifacts)
    return (
        row.select(F.explode(metrics).alias("m")).select("m.*").unionByName(held).unionByName(headline)
        .select(F.lit(label).alias("side"), "metric", "value")
    )


def diff(a: Store, b: Store) -> DataFrame:
    return diff_side(a, b.aliases, "a").unionByName(diff_side(b, a.aliases, "b"))


def diff_examples(store: Store, other_aliases: DataFrame, n: int = 5) -> DataFrame:
    """A few addresses of nodes only this side has (the report shows at most five)."""
    only = presence(store, other_aliases).where("n_aliases > 0 AND n_found = 0")
    return only.select("address").orderBy("address").limit(n)


# ── synchronisation ──────────────────────────────────────────────────────────


def plan_works(source: Store, dest_aliases: DataFrame) -> DataFrame:
    """(canonical_id, kind, outcome): push, present (all aliases known) or no_alias."""
    outcome = (
        F.when(F.col("n_aliases") == 0, "no_alias").when(F.col("n_found") == F.col("n_aliases"), "present").otherwise("push")
    )
    return presence(source, dest_aliases).select("canonical_id", "kind", outcome.alias("outcome"))


def work_records(source: Store, plan: DataFrame, dest_assertions: DataFrame | None = None) -> DataFrame:
    """(canonical_id, kind, source, attrs, fetched_at): one record per assertion of a pushed node.

    A stub is pushed as one empty `migration` record so that its aliases travel. By default the
    newer assertions of a node already present stay behind; `dest_assertions` (canonical_id as
    in the source, source, fetched_at) turns on the refresh that sends those too.
    """
    pushed = plan.where("outcome = 'push'").select("canonical_id", "kind")
    none = F.lit(None).cast("string")
    claims = source.assertions.select("canonical_id", "source", "attrs", "fetched_at")
    out = (
        pushed.join(claims, "canonical_id", "left")
        .withColumn("attrs", F.when(F.col("source").isNull(), F.lit("{}")).otherwise(F.col("attrs")))
        .withColumn("fetched_at", F.when(F.col("source").isNull(), none).otherwise(F.col("fetched_at")))
        .withColumn("source", F.coalesce("source", F.lit("migration")))
    )
    if dest_assertions is not None:
        held = dest_assertions.select("canonical_id", "source", F.col("fetched_at").alias("_held_at"))
        newer = (
            plan.where("outcome = 'present'").select("canonical_id", "kind")
            .join(claims, "canonical_id")
            .join(held, ["canonical_id", "source"], "left")
            .where(F.col("_held_at").isNull() | (F.col("fetched_at") > F.col("_held_at")))
            .drop("_held_at")
        )
        out = out.unionByName(newer)
    return out


def plan_edges(source: Store) -> DataFrame:
    """Edge assertions with both ends named by their address alias; `outcome` is push or no_alias."""
    names = source.live_nodes().join(address_alias(source.aliases), "canonical_id").select("canonical_id", alias_text().alias("name"))
    src = names.select(F.col("canonical_id").alias("src_id"), F.col("name").alias("src"))
    dst = names.select(F.col("canonical_id").alias("dst_id"), F.col("name").alias("dst"))
    named = source.edge_assertions.join(src, "src_id", "left").join(dst, "dst_id", "left")
    unnamed = F.col("src").isNull() | F.col("dst").isNull()
    return named.withColumn("outcome", F.when(unnamed, "no_alias").otherwise("push"))


def plan_artifacts(source: Store, dest: Store, blobs: DataFrame | None = None) -> DataFrame:
    """Current artifacts with `outcome`: no_alias, present (destination holds the role), missing_blob or push.

    `blobs` (key) lists the blobs the source really holds. `derived_from` does not travel.
    """
    current = source.artifacts.where("is_current")
    addressed = source.live_nodes().join(address_alias(source.aliases), "canonical_id").select("canonical_id", *ALIAS_KEY)
    live = resolve_live(dest.nodes)
    dest_named = dest.aliases.join(live, "canonical_id").select(*ALIAS_KEY, F.col("live_id").alias("_dest_id"))
    dest_held = dest.artifacts.where("is_current").select(F.col("canonical_id").alias("_dest_id"), "role", F.lit(True).alias("_held"))
    out = (
        current.join(addressed, "canonical_id", "left")
        .join(dest_named, ALIAS_KEY, "left")
        .join(dest_held.distinct(), ["_dest_id", "role"], "left")
    )
    missing = F.lit(False)
    if blobs is not None:
        out = out.join(blobs.select("key").distinct().withColumn("_blob", F.lit(True)), "key", "left")
        missing = F.col("_blob").isNull()
    outcome = (
        F.when(F.col("scheme").isNull(), "no_alias").when(F.col("_held"), "present").when(missing, "missing_blob").otherwise("push")
    )
    return out.select("canonical_id", "role", "version", outcome.alias("outcome"))


def sync_report(works: DataFrame, records: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(category, outcome, count); a run is partial when anything but push and present occurs."""

    def tally(df: DataFrame, category: str) -> DataFrame:
        return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("count")).select(F.lit(category).alias("category"), "outcome", "count")

    sent = records.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("records").alias("category"), F.lit("push").alias("outcome"), "count"
    )
    return tally(works, "works").unionByName(sent).unionByName(tally(edges, "edges")).unionByName(tally(artifacts, "artifacts"))


def is_partial(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or(~F.col("outcome").isin("push", "present")), F.lit(False)).alias("partial"))


# ── deletion ─────────────────────────────────────────────────────────────────


def delete_network(store: Store, requested: DataFrame) -> DataFrame:
    """(canonical_id, root_id): every node that forwards into a requested one, and that one itself."""
    live = resolve_live(store.nodes)
    roots = requested.select("canonical_id").join(live, "canonical_id").select(F.col("live_id")).distinct()
    return live.join(roots, "live_id", "left_semi").select("canonical_id", F.col("live_id").alias("root_id"))


def delete_plan(store: Store, requested: DataFrame) -> DataFrame:
    """(root_id, redirects, aliases, artifacts, edges) that deleting each requested work would remove."""
    network = delete_network(store, requested)
    touching = store.edges().select(
        F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("canonical_id"), "src_id", "dst_id", "relation"
    )
    edge_roots = touching.join(network, "canonical_id").select("root_id", "src_id", "dst_id", "relation").distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("root_id").agg(F.count(F.lit(1)).alias(name))

    counts = [
        count(store.aliases.join(network, "canonical_id"), "aliases"),
        count(store.artifacts.join(network, "canonical_id"), "artifacts"),
        count(edge_roots, "edges"),
    ]
    plan = network.groupBy("root_id").agg((F.count(F.lit(1)) - 1).alias("redirects"))
    for each in counts:
        plan = plan.join(each, "root_id", "left")
    return plan.fillna(0)


def delete_works(store: Store, requested: DataFrame) -> tuple[Store, DataFrame]:
    """The store without the networks of the requested works, and the keys of the blobs to remove."""
    network = delete_network(store, requested).select("canonical_id")
    ends = lambda column: network.select(F.col("canonical_id").alias(column))
    keep = lambda df: df.join(network, "canonical_id", "left_anti")
    keys = store.artifacts.join(network, "canonical_id", "left_semi").select("key")
    edges = store.edge_assertions.join(ends("src_id"), "src_id", "left_anti").join(ends("dst_id"), "dst_id", "left_anti")
    return (
        Store(keep(store.nodes), keep(store.aliases), keep(store.assertions), edges, keep(store.artifacts)),
        keys,
    )
