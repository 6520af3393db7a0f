"""Comparing and merging two collections of notes, node by node, against a recorded base.

Collections are note files (slug, text); the base is (key, hash) of content both sides held
after the last run, keyed by anchor, by `doc:<slug>` for a note's header, or by file name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from citegraph.functions import notes_grammar as g
from citegraph.functions.columns import text_lines, trim_end
from citegraph.functions.ranking import best_row
from citegraph.session import cut_lineage



def headers(files: DataFrame) -> DataFrame:
    """(slug, lines, hash): the frontmatter block and the lines before the first heading. Row-local."""
    split = files.select("slug", text_lines(F.col("text")).alias("all")).withColumn("fence", g.closing_fence(F.col("all")))
    heads = F.transform("all", lambda l, i: F.when((i >= F.col("fence")) & F.startswith(l, F.lit("## ")), i))
    first = F.coalesce(F.array_min(heads), F.size("all"))
    cut = split.select("slug", F.slice("all", F.lit(1), first).alias("lines"))
    return cut.withColumn("hash", g.lines_hash(F.col("lines")))


def units(files: DataFrame) -> DataFrame:
    """(slug, ord, anchor, title, heading, body, hash): one row per heading. Row-local."""
    split = files.select("slug", text_lines(F.col("text")).alias("lines"))
    cut = split.select("slug", F.explode(g.sections(F.col("lines"), g.closing_fence(F.col("lines")))).alias("s"))
    return cut.select(
        "slug", "s.ord", g.heading_anchor(F.col("s.heading")).alias("anchor"), g.heading_title(F.col("s.heading")).alias("title"),
        "s.heading", "s.body", g.body_hash(F.col("s.heading"), F.col("s.body")).alias("hash"),
    )


# ── comparison ───────────────────────────────────────────────────────────────


def diff_notes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(anchor, doc, title, state): only_in_a, only_in_b, moved, differing or in_sync; `doc` is side a's where it has one."""

    def indexed(files: DataFrame, side: str) -> DataFrame:
        anchored = units(files).where(F.col("anchor").isNotNull()).select("anchor", "slug", "ord", "hash", "title")
        last = best_row(anchored, ["anchor"], [F.desc("slug"), F.desc("ord")])
        return last.select("anchor", *[F.col(c).alias(f"{side}_{c}") for c in ("slug", "hash", "title")])

    both = indexed(a, "a").join(indexed(b, "b"), "anchor", "full")
    state = (
        F.when(F.col("b_slug").isNull(), "only_in_a")
        .when(F.col("a_slug").isNull(), "only_in_b")
        .when(F.col("a_slug") != F.col("b_slug"), "moved")
        .when(F.col("a_hash") != F.col("b_hash"), "differing")
        .otherwise("in_sync")
    )
    return both.select(
        "anchor", F.coalesce("a_slug", "b_slug").alias("doc"), F.coalesce("a_title", "b_title").alias("title"), state.alias("state")
    )


def unanchored(files: DataFrame) -> DataFrame:
    """Headings that are invisible to synchronisation."""
    return units(files).where(F.col("anchor").isNull()).select("slug", "ord", "title")


# ── three-way merge ──────────────────────────────────────────────────────────


@dataclass
class MergePlan:
    """node_actions (anchor, doc, title, action); header_actions (doc, action); writes (slug, text);
    state_after (key, hash)."""

    node_actions: DataFrame
    header_actions: DataFrame
    writes: DataFrame
    state_after: DataFrame


def _node_plan(source: DataFrame, dest: DataFrame, base: DataFrame) -> DataFrame:
    """One row per anchor with both sides, the base and the action. Repeats of an anchor within the source
    are `duplicate_anchor` and transfer nothing."""
    s_units = source.where(F.col("anchor").isNotNull())
    first = best_row(s_units, ["anchor"], ["slug", "ord"])
    repeats = s_units.join(first.select("slug", "ord"), ["slug", "ord"], "left_anti")
    d_units = best_row(dest.where(F.col("anchor").isNotNull()), ["anchor"], [F.desc("slug"), "ord"])
    side = lambda df, p: df.select("anchor", *[F.col(c).alias(f"{p}_{c}") for c in ("slug", "ord", "title", "heading", "body", "hash")])
    recorded = base.select(F.col("key").alias("anchor"), F.col("hash").alias("base_hash"))
    met = side(first, "s").join(side(d_units, "d"), "anchor", "full").join(recorded, "anchor", "left")
    lacks = F.size(g.missing_lines(F.col("d_body"), F.col("s_body"))) > 0
    action = (
        F.when(F.col("s_slug").isNull(), F.when(F.col("base_hash").isNotNull(), "deleted_on_source").otherwise("dest_only"))
        .when(F.col("d_slug").isNull(), F.when(F.col("base_hash").isNotNull(), "deleted_on_dest").otherwise("add"))
        .when(F.col("s_slug") != F.col("d_slug"), "moved")
        .when(F.col("s_hash") == F.col("d_hash"), "in_sync")
        .when(F.col("base_hash") == F.col("d_hash"), "replace")
        .when(F.col("base_hash") == F.col("s_hash"), "dest_wins")
        .when(trim_end(F.col("s_heading")) == trim_end(F.col("d_heading")), F.when(lacks, "line_union").otherwise("dest_superset"))
        .otherwise("conflict")
    )
    planned = met.withColumn("action", action)
    extra = side(repeats, "s").withColumn("action", F.lit("duplicate_anchor"))
    return planned.unionByName(extra, allowMissingColumns=True)


def _header_plan(source: DataFrame, dest: DataFrame, base: DataFrame, grown: DataFrame) -> DataFrame:
    """(slug, action, s_lines, s_hash) per source note; `grown` are the notes that receive additions."""
    s = source.select("slug", F.col("lines").alias("s_lines"), F.col("hash").alias("s_hash"))
    d = dest.select("slug", F.col("hash").alias("d_hash"))
    recorded = base.where(F.startswith("key", F.lit("doc:"))).select(F.substr("key", F.lit(5)).alias("slug"), F.col("hash").alias("base_hash"))
    met = s.join(d, "slug", "left").join(recorded, "slug", "left").join(grown.withColumn("_grown", F.lit(True)), "slug", "left")
    action = (
        F.when(F.col("d_hash").isNull(), F.when(F.col("_grown"), "created").otherwise("absent"))
        .when(F.col("s_hash") == F.col("d_hash"), "in_sync")
        .when(F.col("base_hash") == F.col("d_hash"), "replace")
        .when(F.col("base_hash") == F.col("s_hash"), "dest_wins")
        .otherwise("conflict")
    )
    return met.select("slug", action.alias("action"), "s_lines", "s_hash")


def plan_merge(source: DataFrame, dest: DataFrame, base: DataFrame) -> MergePlan:
    """Directional merge of note files, source into destination.

    What only one side has is added to the other and nothing is removed. Where one side changed a node its version
    stands; where both did, lines are united, or the node is left alone if its headings differ. Hashes are
    recorded for what both sides hold in the end.
    """
    # Both collections are parsed once and the plan is made once; all results below read the written tables.
    d_units, d_heads = cut_lineage(units(dest)), cut_lineage(headers(dest))
    plan = cut_lineage(_node_plan(units(source), d_units, base))
    additions = plan.where("action = 'add'").select(
        F.col("s_slug").alias("slug"), F.lit(1).alias("late"), F.col("s_ord").alias("ord"),
        F.col("s_heading").alias("heading"), F.col("s_body").alias("body"),
    )
    head_plan = cut_lineage(_header_plan(headers(source), d_heads, base, additions.select("slug").distinct()))
    edits = plan.where("action IN ('replace', 'line_union')").select(
        F.col("d_slug").alias("slug"), F.col("d_ord").alias("ord"),
        F.when(F.col("action") == "replace", F.col("s_heading")).otherwise(F.col("d_heading")).alias("_heading"),
        F.when(F.col("action") == "replace", F.col("s_body"))
        .otherwise(g.union_lines(F.col("d_body"), F.col("s_body"))).alias("_body"),
    )
    changed = (
        edits.select("slug").unionByName(additions.select("slug"))
        .unionByName(head_plan.where("action = 'replace'").select("slug")).distinct()
    )
    kept = (
        d_units.join(changed, "slug", "left_semi")
        .join(edits, ["slug", "ord"], "left")
        .select("slug", F.lit(0).alias("late"), "ord", F.coalesce("_heading", "heading").alias("heading"), F.coalesce("_body", "body").alias("body"))
    )
    # The nodes of one note meet in one row: a note is one file.
    gathered = kept.unionByName(additions).groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("late", "ord", "heading", "body"))).alias("nodes")
    )

    def lines_of(nodes):
        def one(n, i):
            before_addition = F.coalesce(F.get(nodes, i + 1)["late"] == 1, F.lit(False))
            needs_blank = before_addition & F.coalesce(trim_end(F.element_at(n["body"], -1)) != "", F.lit(True))
            gap = F.when(needs_blank, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            return F.concat(F.array(n["heading"]), n["body"], gap)

        return F.flatten(F.transform(nodes, one))

    heads = (
        changed.join(d_heads.select("slug", F.col("lines").alias("d_lines")), "slug", "left")
        .join(head_plan, "slug", "left")
        .select("slug", F.when(F.col("action").isin("replace", "created"), F.col("s_lines")).otherwise(F.col("d_lines")).alias("head"))
    )
    empty = F.array().cast("array<string>")
    whole = F.concat(F.col("head"), F.coalesce(lines_of(F.col("nodes")), empty), F.array(F.lit("")))
    writes = heads.join(gathered, "slug", "left").select("slug", F.array_join(whole, "\n").alias("text"))
    state = plan.where("action IN ('add', 'in_sync', 'replace')").select(F.col("anchor").alias("key"), F.col("s_hash").alias("hash"))
    head_state = head_plan.where("action IN ('in_sync', 'replace', 'created')").select(
        F.concat(F.lit("doc:"), "slug").alias("key"), F.col("s_hash").alias("hash")
    )
    return MergePlan(
        node_actions=plan.select(
            "anchor", F.coalesce("s_slug", "d_slug").alias("doc"), F.coalesce("s_title", "d_title").alias("title"), "action"
        ),
        header_actions=head_plan.select(F.col("slug").alias("doc"), "action"),
        writes=writes,
        state_after=state.unionByName(head_state),
    )


def plan_file_sync(source: DataFrame, dest: DataFrame, base: DataFrame, prefix: str = "") -> DataFrame:
    """(name, action, content, key, hash) for opaque files (name, content): add, deleted_on_dest, in_sync, replace,
    dest_wins, conflict, deleted_on_source or dest_only. `content` is set where it must be written, `hash` where
    it must be recorded."""
    side = lambda df, p: df.select("name", F.col("content").alias(f"{p}_content"), F.sha2("content", 256).alias(f"{p}_hash"))
    recorded = base.where(F.startswith("key", F.lit(prefix))).select(
        F.substr("key", F.lit(len(prefix) + 1)).alias("name"), F.col("hash").alias("base_hash")
    )
    met = side(source, "s").join(side(dest, "d"), "name", "full").join(recorded, "name", "left")
    action = (
        F.when(F.col("s_hash").isNull(), F.when(F.col("base_hash").isNotNull(), "deleted_on_source").otherwise("dest_only"))
        .when(F.col("d_hash").isNull(), F.when(F.col("base_hash").isNotNull(), "deleted_on_dest").otherwise("add"))
        .when(F.col("s_hash") == F.col("d_hash"), "in_sync")
        .when(F.col("base_hash") == F.col("d_hash"), "replace")
        .when(F.col("base_hash") == F.col("s_hash"), "dest_wins")
        .otherwise("conflict")
    )
    planned = met.withColumn("action", action)
    return planned.select(
        "name", "action", F.when(F.col("action").isin("add", "replace"), F.col("s_content")).alias("content"),
        F.concat(F.lit(prefix), "name").alias("key"),
        F.when(F.col("action").isin("add", "replace", "in_sync"), F.col("s_hash")).alias("hash"),
    )
