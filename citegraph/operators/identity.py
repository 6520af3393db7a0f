"""Identity: which provider records and known nodes are the same thing, and what a merge rewrites.

Records that share an alias, directly or through others, are one node. That is a
connected-components problem over records, aliases and known nodes. Survivor: the
smallest known id of a component, else a new id derived from its smallest alias.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.functions.ranking import best_row, running_total
from citegraph.session import Rounds, cut_lineage

ALIAS_KEY = ["scheme", "value"]
MAX_ROUNDS = 60

# Strength order of alias schemes when one alias must speak for a bundle.
SCHEME_STRENGTH = ("doi", "pmid", "pmcid", "openalex", "semantic_scholar", "arxiv")
# Schemes preferred for addressing a node in another store.
ADDRESS_SCHEMES = ("openalex", "doi")


def minted_id(key: Column) -> Column:
    """A UUID-shaped id that is a function of `key`, so a retried task mints the same one."""
    digest = F.sha2(key, 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def alias_text(scheme: str | Column = "scheme", value: str | Column = "value") -> Column:
    return F.concat_ws(":", scheme, value)


def normalize_dois(aliases: DataFrame) -> DataFrame:
    """Optional: fold the case of DOIs, which otherwise match exactly and can fork identity."""
    return aliases.withColumn("value", F.when(F.col("scheme") == "doi", F.lower("value")).otherwise(F.col("value")))


# ── connected components ─────────────────────────────────────────────────────


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every vertex is either a root or linked to exactly one root: contraction is done.

    Counts per vertex are combined on the map side, so a hub costs no more than any vertex.
    """
    one, zero = F.lit(1).alias("up"), F.lit(0).alias("up")
    ends = pairs.select(F.col("u").alias("x"), one, F.lit(0).alias("down")).unionByName(
        pairs.select(F.col("v").alias("x"), zero, F.lit(1).alias("down"))
    )
    open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)")
    return open_.isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex it knows. Pairs are (u > v)."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return pairs.join(least, "v").select("u", F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(pairs: DataFrame) -> DataFrame:
    """(vertex, root): root is the smallest vertex of the component. Isolated vertices do not appear.

    Alternating large-star / small-star contraction. A vertex's neighbours are never
    collected: each half is a minimum per vertex (combined on the map side) joined back
    to its pairs. A hub is a hot join key on the pair side only, which the adaptive
    skew join splits; the other side has one row per vertex.
    """
    rounds = Rounds(pairs.sparkSession)
    state = rounds.step(
        pairs.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(MAX_ROUNDS):
        if _is_star_forest(state):
            break
        state = rounds.step(_small_star(_large_star(state)))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = state.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root"))
    return state.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)


@dataclass
class Resolution:
    """What a batch of records does to the catalog.

    record_nodes: (record_id, canonical_id); aliases: (scheme, value, canonical_id), new and
    repointed; new_nodes: (canonical_id, kind, merged_into); redirects: (loser_id, canonical_id).
    """

    record_nodes: DataFrame
    aliases: DataFrame
    new_nodes: DataFrame
    redirects: DataFrame


def resolve_identity(
    record_aliases: DataFrame,
    known_aliases: DataFrame | None = None,
    record_kinds: DataFrame | None = None,
) -> Resolution:
    """Attach records to nodes, minting and merging nodes as their aliases demand.

    `record_aliases`: (record_id, seq, scheme, value), one row per alias; a record without
    aliases has null scheme and value and becomes a node nobody can address.
    `known_aliases`: (scheme, value, canonical_id) of live nodes. Only those whose key occurs
    in the batch are read: a known node's other aliases cannot join anything new.
    `record_kinds`: (record_id, seq, kind); a new node takes the kind of its first record.
    """
    # Read many times below: written once, so that whatever derives the aliases (digests of
    # whole texts, say) is not computed again each time.
    record_aliases = cut_lineage(record_aliases.select("record_id", "scheme", "value"))
    bundle = record_aliases.where(F.col("scheme").isNotNull())
    vertex = F.concat(F.lit("r:"), F.col("record_id"))
    holders = bundle.select(*ALIAS_KEY, vertex.alias("u"))
    if known_aliases is not None:
        touched = known_aliases.join(bundle.select(*ALIAS_KEY).distinct(), ALIAS_KEY, "left_semi")
        known_vertex = F.concat(F.lit("n:"), F.col("canonical_id"))
        holders = holders.unionByName(touched.select(*ALIAS_KEY, known_vertex.alias("u")))
    # One star per alias: every holder points at the smallest. "n:" sorts before "r:", so a
    # component's root is its smallest known node where it has one.
    least = holders.groupBy(*ALIAS_KEY).agg(F.min("u").alias("v"), F.max("u").alias("_max"))
    shared = least.where(F.col("v") != F.col("_max")).drop("_max")
    pairs = holders.join(shared, ALIAS_KEY).select("u", "v")
    roots = connected_components(pairs)

    all_records = record_aliases.select("record_id", vertex.alias("vertex")).distinct()
    labelled = all_records.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    first_alias = (
        record_aliases.join(labelled.select("record_id", "root"), "record_id")
        .groupBy("root")
        .agg(F.min(alias_text()).alias("key"))
    )
    is_known = F.col("root").startswith("n:")
    node_of_root = first_alias.select(
        "root",
        F.when(is_known, F.expr("substring(root, 3)"))
        .otherwise(minted_id(F.coalesce(F.when(F.col("key") != "", F.col("key")), F.concat(F.lit("record "), "root"))))
        .alias("canonical_id"),
        (~is_known).alias("is_new"),
    )
    record_nodes = cut_lineage(labelled.join(node_of_root, "root").select("record_id", "canonical_id", "is_new"))
    redirects = roots.where(F.col("vertex").startswith("n:") & (F.col("vertex") != F.col("root"))).select(
        F.expr("substring(vertex, 3)").alias("loser_id"), F.expr("substring(root, 3)").alias("canonical_id")
    )
    attached = bundle.join(record_nodes, "record_id").select(*ALIAS_KEY, "canonical_id").distinct()
    fresh = record_nodes.where("is_new")
    if record_kinds is not None:
        new_nodes = best_row(
            fresh.join(record_kinds, "record_id").select("canonical_id", "kind", "seq", "record_id"),
            ["canonical_id"], ["seq", "record_id"],
        ).select("canonical_id", "kind")
    else:
        new_nodes = fresh.select("canonical_id", F.lit("work").alias("kind")).distinct()
    return Resolution(
        record_nodes=record_nodes.select("record_id", "canonical_id"),
        aliases=attached,
        new_nodes=new_nodes.withColumn("merged_into", F.lit(None).cast("string")),
        redirects=redirects,
    )


def alias_load(record_aliases: DataFrame, at_least: int) -> DataFrame:
    """Aliases held by `at_least` records or more: candidates for a bad id that welds the corpus."""
    held = record_aliases.where(F.col("scheme").isNotNull()).groupBy(*ALIAS_KEY).agg(F.count_distinct("record_id").alias("records"))
    return held.where(F.col("records") >= at_least)


# ── alias table ──────────────────────────────────────────────────────────────


def get_or_create_aliases(known: DataFrame, claims: DataFrame) -> DataFrame:
    """`known` plus the unknown keys of `claims` (scheme, value, canonical_id, seq); the first claim owns a key."""
    first = claims.groupBy(*ALIAS_KEY).agg(F.min_by("canonical_id", F.struct("seq", "canonical_id")).alias("canonical_id"))
    new = first.join(known, ALIAS_KEY, "left_anti")
    columns = [*ALIAS_KEY, "canonical_id"]
    return known.select(*columns).unionByName(new.select(*columns))


def have(known: DataFrame, requested: DataFrame) -> DataFrame:
    """Which of the requested aliases are known, each once."""
    return requested.select(*ALIAS_KEY).distinct().join(known, ALIAS_KEY, "left_semi")


def lookup(requested: DataFrame, known: DataFrame, live: DataFrame) -> DataFrame:
    """Each requested alias with its live node, and `is_known`. `live`: (canonical_id, live_id)."""
    found = requested.join(known.select(*ALIAS_KEY, "canonical_id"), ALIAS_KEY, "left")
    return (
        found.join(live.select("canonical_id", "live_id"), "canonical_id", "left")
        .withColumn("live_id", F.coalesce("live_id", "canonical_id"))
        .withColumn("is_known", F.col("canonical_id").isNotNull())
        .drop("canonical_id")
    )


def preferred_alias(aliases: DataFrame) -> DataFrame:
    """(canonical_id, scheme, value): each node's strongest alias."""
    strength = F.coalesce(
        F.when(F.col("scheme").isin(*SCHEME_STRENGTH), F.array_position(F.lit(list(SCHEME_STRENGTH)), F.col("scheme"))),
        F.lit(255),
    )
    return _smallest_alias(aliases, strength, ["value", "scheme"])


def address_alias(aliases: DataFrame) -> DataFrame:
    """(canonical_id, scheme, value): the alias used to name a node to another store."""
    rank = F.coalesce(
        F.when(F.col("scheme").isin(*ADDRESS_SCHEMES), F.array_position(F.lit(list(ADDRESS_SCHEMES)), F.col("scheme"))),
        F.lit(len(ADDRESS_SCHEMES) + 1),
    )
    return _smallest_alias(aliases, rank, ["scheme", "value"])


def _smallest_alias(aliases: DataFrame, rank: Column, then: list[str]) -> DataFrame:
    order = F.struct(rank.alias("rank"), *then)
    least = aliases.groupBy("canonical_id").agg(F.min(order).alias("a"))
    return least.select("canonical_id", "a.scheme", "a.value")


# ── redirects and merges ─────────────────────────────────────────────────────


def resolve_live(nodes: DataFrame) -> DataFrame:
    """(canonical_id, live_id): the end of every node's `merged_into` chain.

    Pointer jumping over the redirects only (live nodes answer themselves): each round
    doubles the distance covered. A target that is no node is where its chain ends.
    """
    rounds = Rounds(nodes.sparkSession)
    jumps = rounds.step(nodes.where(F.col("merged_into").isNotNull()).select("canonical_id", F.col("merged_into").alias("to_id")))
    # A chain of n redirects ends after log2(n) doublings; one that goes on is a cycle.
    for _ in range(jumps.count().bit_length() + 1):
        onward = jumps.select(F.col("canonical_id").alias("to_id"), F.col("to_id").alias("next_id"))
        stepped = rounds.step(jumps.join(onward, "to_id", "left"))
        if stepped.where(F.col("next_id").isNotNull()).isEmpty():
            jumps = stepped
            break
        jumps = stepped.select("canonical_id", F.coalesce("next_id", "to_id").alias("to_id"))
    else:
        raise RuntimeError("redirects do not end: merged_into has a cycle")
    moved = jumps.select("canonical_id", F.col("to_id").alias("live_id"))
    return nodes.select("canonical_id").join(moved, "canonical_id", "left").withColumn(
        "live_id", F.coalesce("live_id", "canonical_id")
    )


def missing_targets(nodes: DataFrame) -> DataFrame:
    """Redirects whose target is not a node."""
    targets = nodes.select(F.col("canonical_id").alias("merged_into"))
    return nodes.where(F.col("merged_into").isNotNull()).join(targets, "merged_into", "left_anti")


def _repoint(table: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """Replace losers by survivors in `column`; `was_<column>` keeps the old value."""
    moves = redirects.select(F.col("loser_id").alias(column), F.col("canonical_id").alias("_survivor"))
    joined = table.join(moves, column, "left").withColumn(f"was_{column}", F.col(column))
    return joined.withColumn(column, F.coalesce("_survivor", column)).drop("_survivor")


def merge_nodes(nodes: DataFrame, redirects: DataFrame) -> DataFrame:
    """Losers get `merged_into` = survivor."""
    moves = redirects.select(F.col("loser_id").alias("canonical_id"), F.col("canonical_id").alias("_survivor"))
    return (
        nodes.join(moves, "canonical_id", "left")
        .withColumn("merged_into", F.coalesce("_survivor", "merged_into"))
        .drop("_survivor")
    )


def merge_aliases(aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    return _repoint(aliases, redirects, "canonical_id").select(*ALIAS_KEY, "canonical_id")


def merge_node_assertions(assertions: DataFrame, redirects: DataFrame) -> DataFrame:
    """Per (survivor, provider) the strictly newer claim; a tie keeps the survivor's own."""
    moved = _repoint(assertions, redirects, "canonical_id")
    own_first = F.when(F.col("was_canonical_id") == F.col("canonical_id"), 0).otherwise(1)
    kept = best_row(moved, ["canonical_id", "source"], [F.desc("fetched_at"), own_first, "was_canonical_id"])
    return kept.drop("was_canonical_id")


def merge_edges(edges: DataFrame, redirects: DataFrame) -> DataFrame:
    """Both ends repointed and folded; a merge of citing with cited leaves a self-loop."""
    moved = _repoint(_repoint(edges, redirects, "src_id"), redirects, "dst_id")
    return moved.select("src_id", "dst_id", "relation").distinct()


def merge_edge_assertions(assertions: DataFrame, redirects: DataFrame) -> DataFrame:
    """As `merge_edges`, keeping per provider the newest claim; a tie keeps the one already in place."""
    moved = _repoint(_repoint(assertions, redirects, "src_id"), redirects, "dst_id")
    in_place = F.when(
        (F.col("was_src_id") == F.col("src_id")) & (F.col("was_dst_id") == F.col("dst_id")), 0
    ).otherwise(1)
    kept = best_row(
        moved, ["src_id", "dst_id", "relation", "source"],
        [F.desc("fetched_at"), in_place, "was_src_id", "was_dst_id"],
    )
    return kept.drop("was_src_id", "was_dst_id")


def merge_artifacts(artifacts: DataFrame, redirects: DataFrame, policy: str = "renumber") -> DataFrame:
    """Repoint artifacts; a loser's current version is demoted where the survivor has one in that role.

    On a version collision `renumber` keeps both (loser versions continue after the survivor's,
    and `derived_from_version` follows); `drop` keeps only the survivor's row.
    Where several losers hold a current version and the survivor none, the smallest loser's stays.
    """
    if policy not in ("renumber", "drop"):
        raise ValueError(f"policy must be 'renumber' or 'drop', not {policy!r}")
    moved = _repoint(artifacts, redirects, "canonical_id").withColumn(
        "was_rank", F.when(F.col("was_canonical_id") == F.col("canonical_id"), 0).otherwise(1)
    )
    owner = F.struct("was_rank", "was_canonical_id")
    current = moved.where("is_current").groupBy("canonical_id", "role").agg(F.min(owner).alias("_current_owner"))
    moved = moved.join(current, ["canonical_id", "role"], "left").withColumn(
        "is_current", F.col("is_current") & (F.col("_current_owner") == owner)
    )
    if policy == "drop":
        kept = best_row(moved, ["canonical_id", "role", "version"], ["was_rank", "was_canonical_id"])
        return kept.drop("was_canonical_id", "was_rank", "_current_owner")
    # How far the versions of the owners before each owner reach. Owners are summed over
    # range-split stretches: one welded node may have swallowed very many of them.
    reach = moved.groupBy("canonical_id", "role", "was_rank", "was_canonical_id").agg(F.max("version").alias("_reach"))
    shifts = running_total(
        reach, ["canonical_id", "role"], ["was_rank", "was_canonical_id"], F.col("_reach"), "_sum"
    ).select("canonical_id", "role", "was_canonical_id", (F.col("_sum") - F.col("_reach")).cast("int").alias("_shift"))
    own = moved.join(shifts, ["canonical_id", "role", "was_canonical_id"])
    parent = shifts.select(
        "canonical_id", "was_canonical_id", F.col("role").alias("derived_from_role"), F.col("_shift").alias("_parent_shift")
    )
    out = own.join(parent, ["canonical_id", "was_canonical_id", "derived_from_role"], "left")
    return (
        out.withColumn("version", F.col("version") + F.col("_shift"))
        .withColumn("derived_from_version", F.col("derived_from_version") + F.coalesce("_parent_shift", F.lit(0)))
        .drop("was_canonical_id", "was_rank", "_current_owner", "_shift", "_parent_shift")
    )
