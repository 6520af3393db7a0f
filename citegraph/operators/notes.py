"""The notes graph: nodes, labels, properties, links and warnings lifted from Markdown notes.

Input is one row per note file: (slug, text), the slug being the file stem.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.functions import notes_grammar as g
from citegraph.functions.columns import text_lines, trim, trim_end
from citegraph.functions.ranking import best_row, first_rows
from citegraph.session import cut_lineage

NO_ANCHOR = "this heading has no anchor"
NO_FRONTMATTER = "the note has no frontmatter"
MALFORMED_MAP = "the braces hold no readable map"
NEITHER_FORM = "a link line in neither of the two forms"

# Keys a note must state, and the order of reading roles.
REQUIRED_FRONTMATTER = ("doc",)
READING_ROLES = ("start-here", "core", "rigor", "reference")

# The alphabet and length of an anchor.
ANCHOR_ALPHABET = "23456789abcdefghjkmnpqrstvwxyz"
ANCHOR_LENGTH = 7
MAX_SALTS = 50


def documents(files: DataFrame) -> DataFrame:
    """(slug, doc, has_frontmatter, block, fence, lines) of each note. Row-local."""
    split = files.select("slug", text_lines(F.col("text")).alias("lines"))
    fenced = split.withColumn("fence", g.closing_fence(F.col("lines")))
    blocks = fenced.withColumn("block", g.frontmatter(F.col("lines"), F.col("fence")))
    return blocks.select(
        "slug", F.coalesce(g.frontmatter_value(F.col("block"), "doc"), "slug").alias("doc"),
        (F.size("block") > 0).alias("has_frontmatter"), "block", "fence", "lines",
    )


def node_rows(files: DataFrame) -> DataFrame:
    """(slug, doc, ord, id, title, heading_line, body): one row per heading. Row-local.

    Under an empty frontmatter block lines are counted from below its fences.
    """
    docs = documents(files)
    shift = F.when(F.col("fence") == 2, 2).otherwise(0)
    cut = docs.select("slug", "doc", shift.alias("shift"), F.explode(g.sections(F.col("lines"), F.col("fence"))).alias("s"))
    return cut.select(
        "slug", "doc", "s.ord", "s.id", "s.title", (F.col("s.line") - F.col("shift")).alias("heading_line"), F.col("s.body").alias("body")
    )


def bullet_rows(nodes: DataFrame) -> DataFrame:
    """(slug, doc, ord, id, line, text, form, source, kind, target, key, raw, m): one row per bullet. Row-local."""
    items = nodes.select("slug", "doc", "ord", "id", "heading_line", F.explode(g.read_bullets(F.col("body"))).alias("b"))
    return _bullet_columns(items)


def _bullet_columns(items: DataFrame) -> DataFrame:
    return items.select(
        "slug", "doc", "ord", "id", (F.col("heading_line") + F.col("b.at")).alias("line"), F.col("b.text").alias("text"), "b.c.*", F.col("b.m").alias("m")
    )


@dataclass
class NotesGraph:
    """nodes (slug, doc, ord, id, title, heading_line); labels (…, label); properties (…, key, value,
    is_map, entries); links (…, source, kind, target, entries, recorded_in); warnings (doc, line, message)."""

    documents: DataFrame
    nodes: DataFrame
    labels: DataFrame
    properties: DataFrame
    links: DataFrame
    warnings: DataFrame


def parse_notes(files: DataFrame) -> DataFrame:
    """(slug, doc, has_frontmatter, block, sections): each note read once, its bullets nested in its sections. Row-local."""
    docs = documents(files)
    shift = F.when(F.col("fence") == 2, 2).otherwise(0)
    read = lambda s: F.struct(
        s["ord"].alias("ord"), s["id"].alias("id"), s["title"].alias("title"), (s["line"] - shift).alias("heading_line"),
        g.read_bullets(s["body"]).alias("bullets"),
    )
    return docs.select(
        "slug", "doc", "has_frontmatter", "block", F.transform(g.sections(F.col("lines"), F.col("fence")), read).alias("sections")
    )


def lift_notes(files: DataFrame) -> NotesGraph:
    """All tables of the notes graph. The texts are read once and the parse is written out; the tables are
    projections of it, but for `properties`, where the last of equal keys must win."""
    parsed = cut_lineage(parse_notes(files))
    docs = parsed.select("slug", "doc", "has_frontmatter", "block")
    nodes = parsed.select("slug", "doc", F.explode("sections").alias("s")).select(
        "slug", "doc", "s.ord", "s.id", "s.title", "s.heading_line", "s.bullets"
    )
    bullets = _bullet_columns(nodes.select("slug", "doc", "ord", "id", "heading_line", F.explode("bullets").alias("b")))
    at = ["slug", "doc", "ord", "id", "line"]

    tags = bullets.where("form = 'tags'").select(
        *at, F.posexplode(F.filter(F.split("raw", r"(?U)\s+"), lambda t: t != "")).alias("place", "tag")
    )
    labels = tags.select(*at, "place", F.regexp_replace("tag", r"\A#+", "").alias("label"))

    value = F.when(F.col("m.is_map") & ~F.col("m.malformed"), g.entries_json(F.col("m.entries"))).otherwise(F.col("raw"))
    stated = bullets.where("form = 'property'").select(
        *at, "key", value.alias("value"), (F.col("m.is_map") & ~F.col("m.malformed")).alias("is_map"), F.col("m.entries").alias("entries")
    )
    own = best_row(stated.where("key <> 'title'"), ["slug", "ord", "key"], [F.desc("line")])
    titles = nodes.select(
        "slug", "doc", "ord", "id", F.col("heading_line").alias("line"), F.lit("title").alias("key"), F.col("title").alias("value"),
        F.lit(False).alias("is_map"), F.array().cast("array<struct<key:string,value:string>>").alias("entries"),
    )
    enclosing = F.struct(F.lit("node").alias("type"), F.lit(None).cast("string").alias("scheme"), F.coalesce("id", F.lit("")).alias("value"))
    links = bullets.where("form IN ('explicit', 'implicit')").select(
        *at, F.when(F.col("form") == "explicit", g.endpoint(F.col("source"))).otherwise(enclosing).alias("source"), "kind",
        g.endpoint(F.col("target")).alias("target"), F.col("m.entries").alias("entries"), F.col("id").alias("recorded_in"),
    )
    warn = lambda df, line, message: df.select("slug", "doc", line.cast("int").alias("line"), F.lit(message).alias("message"))
    warnings = (
        warn(docs.where(~F.col("has_frontmatter")), F.lit(0), NO_FRONTMATTER)
        .unionByName(warn(nodes.where(F.col("id").isNull()), F.col("heading_line"), NO_ANCHOR))
        .unionByName(warn(bullets.where("m.malformed AND form IN ('explicit', 'implicit', 'property')"), F.col("line"), MALFORMED_MAP))
        .unionByName(warn(bullets.where("form = 'broken_link'"), F.col("line"), NEITHER_FORM))
    )
    return NotesGraph(docs, nodes.drop("bullets"), labels, own.unionByName(titles), links, warnings)


# ── indexes ──────────────────────────────────────────────────────────────────


def nodes_by_id(nodes: DataFrame) -> DataFrame:
    """One node per anchor; of duplicates the last by document and order."""
    return best_row(nodes.where(F.col("id").isNotNull()), ["id"], [F.desc("doc"), F.desc("ord"), F.desc("slug")])


def nodes_by_label(labels: DataFrame) -> DataFrame:
    return labels.select("label", "slug", "doc", "ord", "id")


def links_touching(links: DataFrame) -> DataFrame:
    """(node_id, slug, ord, line, end, kind): each link under the node at either end; a self-link twice."""
    ends = F.array(*[F.struct(F.lit(end).alias("end"), F.col(end).alias("e")) for end in ("source", "target")])
    rows = links.select("slug", "ord", "line", "kind", F.explode(ends).alias("x")).where("x.e.type = 'node'")
    return rows.select(F.col("x.e.value").alias("node_id"), "slug", "ord", "line", F.col("x.end").alias("end"), "kind")


def _ends_by_document(graph: NotesGraph) -> DataFrame:
    """(source_doc, end): both ends of every link recorded in a known node, with that node's document."""
    home = nodes_by_id(graph.nodes).select(F.col("id").alias("recorded_in"), F.col("doc").alias("source_doc"))
    return graph.links.join(home, "recorded_in").select("source_doc", F.explode(F.array("source", "target")).alias("end"))


def work_index(graph: NotesGraph) -> DataFrame:
    """(work_ref, doc): which documents mention a work. Pairs stay rows, however many mention one work."""
    ends = _ends_by_document(graph).where("end.type = 'catalog'")
    return ends.select(g.endpoint_text(F.col("end")).alias("work_ref"), F.col("source_doc").alias("doc")).distinct()


def cross_references(graph: NotesGraph) -> DataFrame:
    """(doc, target_doc, known): document-to-document links. Dangling targets are kept and marked; read the
    known ones backwards for back-references."""
    ends = _ends_by_document(graph).where("end.type = 'node'").select("source_doc", F.col("end.value").alias("target"))
    named = ends.where(F.startswith("target", F.lit("doc:"))).select("source_doc", F.substr("target", F.lit(5)).alias("target_doc"))
    homes = nodes_by_id(graph.nodes).select(F.col("id").alias("target"), F.col("doc").alias("target_doc"))
    anchored = ends.where(~F.startswith("target", F.lit("doc:"))).join(homes, "target").select("source_doc", "target_doc")
    pairs = named.unionByName(anchored).where("source_doc <> target_doc").distinct()
    known = graph.documents.select(F.col("doc").alias("target_doc")).distinct().withColumn("known", F.lit(True))
    return pairs.join(known, "target_doc", "left").select(
        F.col("source_doc").alias("doc"), "target_doc", F.coalesce("known", F.lit(False)).alias("known")
    )


def reading_list(graph: NotesGraph, both_directions: bool = True) -> DataFrame:
    """(rank, role, doc, slug, ord, why, work_id): nodes with a `reading` property and their first catalog link."""
    stated = lambda name: F.coalesce(F.get(F.filter("entries", lambda e: e["key"] == name), F.lit(0))["value"], F.lit(""))
    reading = graph.properties.where("key = 'reading'").select(
        "slug", "doc", "ord", "id", stated("role").alias("role"), stated("why").alias("why")
    )
    catalog = graph.links.where("kind = 'catalog'")
    place = F.struct("slug", "ord", "line")
    outward = catalog.where("source.type = 'node' AND target.type = 'catalog'").select(
        F.col("source.value").alias("id"), place.alias("place"), g.endpoint_text(F.col("target")).alias("work_id")
    )
    found = outward
    if both_directions:
        found = outward.unionByName(
            catalog.where("target.type = 'node' AND source.type = 'catalog'").select(
                F.col("target.value").alias("id"), place.alias("place"), g.endpoint_text(F.col("source")).alias("work_id")
            )
        )
    first = found.groupBy("id").agg(F.min_by("work_id", "place").alias("work_id"))
    rank = F.coalesce(
        F.when(F.col("role").isin(*READING_ROLES), F.array_position(F.lit(list(READING_ROLES)), F.col("role")) - 1),
        F.lit(len(READING_ROLES)),
    )
    return reading.join(first, "id", "left").select(rank.cast("int").alias("rank"), "role", "doc", "slug", "ord", "why", "work_id")


def document_summary(graph: NotesGraph) -> DataFrame:
    """(doc, nodes, works): nodes per document and distinct works its nodes link to."""
    counted = graph.nodes.groupBy("doc").agg(F.count(F.lit(1)).alias("nodes"))
    outgoing = graph.links.where("source.type = 'node' AND target.type = 'catalog'").select(
        F.col("source.value").alias("id"), g.endpoint_text(F.col("target")).alias("work_ref")
    ).distinct()
    # An anchor written many times, or with many links, meets each document and each work once.
    works = (
        graph.nodes.where(F.col("id").isNotNull()).select("id", "doc").distinct().join(outgoing, "id").select("doc", "work_ref").distinct()
        .groupBy("doc").agg(F.count(F.lit(1)).alias("works"))
    )
    return counted.join(works, "doc", "left").fillna(0, ["works"])


def label_counts(labels: DataFrame, top: int | None = None) -> DataFrame:
    """(doc, label, n), the `top` most frequent labels of each document when given."""
    counts = labels.groupBy("doc", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else first_rows(counts, ["doc"], [F.desc("n"), "label"], top)


def lint(files: DataFrame, graph: NotesGraph) -> DataFrame:
    """(slug, doc, line, warning): advisory findings per note, with the parse warnings of its document."""
    docs = graph.documents
    stated = g.frontmatter_value(F.col("block"), "doc")
    finding = lambda df, text: df.select("slug", "doc", F.lit(0).alias("line"), (text if isinstance(text, Column) else F.lit(text)).alias("warning"))
    out = finding(docs.where(~F.col("has_frontmatter")), NO_FRONTMATTER)
    for key in REQUIRED_FRONTMATTER:
        out = out.unionByName(finding(docs.where(g.frontmatter_value(F.col("block"), key).isNull()), f"the frontmatter lacks `{key}`"))
    out = out.unionByName(finding(docs.where(stated != F.col("slug")), "the note names another document than its file"))
    out = out.unionByName(
        finding(docs.where(g.frontmatter_value(F.col("block"), "domain").isNotNull()), "the old key `domain` is still there")
    )
    with_catalog = _ends_by_document(graph).where("end.type = 'catalog'").select(F.col("source_doc").alias("doc")).distinct()
    out = out.unionByName(finding(docs.join(with_catalog, "doc", "left_anti"), "the note refers to no catalog work"))
    heads = documents(files).select("slug", "doc", F.filter("lines", lambda l: F.rlike(l, F.lit(r"(?U)\A## (?:.*\s)?\^t-\S*\s*\z"))).alias("temp"))
    out = out.unionByName(finding(heads.where(F.size("temp") > 0), "a temporary anchor is left"))
    parsed = docs.select("slug", "doc").join(graph.warnings.select("doc", "line", "message").distinct(), "doc")
    return out.unionByName(parsed.select("slug", "doc", "line", F.col("message").alias("warning")))


# ── anchors ──────────────────────────────────────────────────────────────────


def anchor_from(key: Column) -> Column:
    """`r-` and seven characters of the anchor alphabet, a function of `key`."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")
    base = len(ANCHOR_ALPHABET)
    letter = lambda n: F.substr(F.lit(ANCHOR_ALPHABET), (F.floor(number / base**n) % base + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("r-"), *[letter(n) for n in range(ANCHOR_LENGTH)])


def mint_anchors(wanted: DataFrame, keys: list[str], taken: DataFrame, salt: str = "") -> DataFrame:
    """`wanted` plus a new `anchor`, unique among themselves and against `taken` (anchor).

    Ids are functions of content, so a retried task mints the same ones. Of rows that draw
    one id the first by `keys` keeps it; the rest draw again with another salt.
    """
    done, left = None, wanted
    for round_ in range(MAX_SALTS):
        drawn = left.withColumn("anchor", anchor_from(F.concat_ws("\u001f", F.lit(f"{salt}{round_}"), *[F.col(k).cast("string") for k in keys])))
        free = drawn.join(taken.select("anchor").distinct(), "anchor", "left_anti")
        kept = cut_lineage(best_row(free, ["anchor"], keys))
        done = kept if done is None else done.unionByName(kept)
        left = cut_lineage(left.join(kept.select(*keys), keys, "left_anti"))
        if left.isEmpty():
            return done
        taken = taken.select("anchor").unionByName(kept.select("anchor"))
    raise RuntimeError("anchors kept colliding")


def assign_anchors(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, files): anchors for headings that lack one, and the notes with those headings completed."""
    nodes = node_rows(files).drop("body")
    taken = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("anchor"))
    bare = nodes.where(F.col("id").isNull()).select("slug", "ord", "title", "doc", "heading_line")
    assigned = mint_anchors(bare, ["slug", "ord", "title"], taken)
    # One file's headings meet in one row, as its text already does.
    by_file = assigned.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("ord", "anchor"))).alias("new"))
    docs = documents(files).select("slug", "lines", "fence").join(files.select("slug", "text"), "slug").join(by_file, "slug")
    starts = F.transform("lines", lambda l, i: F.when((i >= F.col("fence")) & F.startswith(l, F.lit("## ")), 1).otherwise(0))
    numbered = docs.withColumn("heads", F.filter(F.transform(starts, lambda s, i: F.when(s == 1, i)), lambda i: i.isNotNull()))
    finish = lambda l, i: F.coalesce(
        F.concat(l, F.lit(" ^"), F.element_at("new", F.array_position("heads", i).cast("int") - 1)), l
    )
    tail = F.when(F.endswith("text", F.lit("\n")), "\n").otherwise("")
    rewritten = numbered.select("slug", F.concat(F.array_join(F.transform("lines", finish), "\n"), tail).alias("text"))
    untouched = files.select("slug", "text").join(by_file.select("slug"), "slug", "left_anti")
    return assigned, rewritten.unionByName(untouched)


@dataclass
class TempAnchors:
    """resolved (temp, anchor, doc, heading_line, title), duplicates (temp, doc), dangling (temp), and rewritten files."""

    resolved: DataFrame
    duplicates: DataFrame
    dangling: DataFrame
    files: DataFrame


def resolve_temp_anchors(files: DataFrame) -> TempAnchors:
    """Give every `^t-…` anchor one lasting id and replace it wherever it is written, in all notes.

    An anchor defined twice is reported and left alone; one referenced but never defined is reported.
    """
    graph = lift_notes(files)
    nodes = graph.nodes
    defined = nodes.where(F.startswith("id", F.lit("t-"))).select(F.col("id").alias("temp"), "doc", "heading_line", "title")
    counts = defined.groupBy("temp").agg(F.count(F.lit(1)).alias("n"))
    duplicates = defined.join(counts.where("n > 1"), "temp").select("temp", "doc")
    taken = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("anchor"))
    single = defined.join(counts.where("n = 1"), "temp", "left_semi")
    resolved = mint_anchors(single, ["temp"], taken, salt="temp")
    used = graph.links.select(F.explode(F.array("source", "target")).alias("e")).where("e.type = 'node' AND startswith(e.value, 't-')")
    dangling = used.select(F.col("e.value").alias("temp")).distinct().join(defined, "temp", "left_anti")

    token = r"\^[A-Za-z0-9-]+"
    written = files.select("slug", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(token), F.lit(0)))).alias("token"))
    known = written.where(F.startswith("token", F.lit("^t-"))).select("slug", F.substr("token", F.lit(2)).alias("temp"))
    by_file = known.join(resolved.select("temp", "anchor"), "temp").groupBy("slug").agg(
        F.map_from_entries(F.collect_list(F.struct("temp", "anchor"))).alias("new")
    )
    between, tokens = F.split("text", token), F.regexp_extract_all("text", F.lit(token), F.lit(0))
    swapped = F.transform(
        tokens, lambda t: F.concat(F.lit("^"), F.coalesce(F.element_at(F.col("new"), F.substr(t, F.lit(2))), F.substr(t, F.lit(2))))
    )
    rebuilt = F.array_join(F.flatten(F.zip_with(between, swapped, lambda b, t: F.array(b, F.coalesce(t, F.lit(""))))), "")
    changed = files.join(by_file, "slug").select("slug", rebuilt.alias("text"))
    same = files.select("slug", "text").join(by_file.select("slug"), "slug", "left_anti")
    return TempAnchors(resolved, duplicates, dangling, changed.unionByName(same))


def write_gate(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(slug, outcome): `blocked` by a warning other than a missing anchor, `conflict` where an anchor is
    in use in another stored note, else `accepted`. `force` lets warnings pass, never conflicts."""
    graph = lift_notes(incoming)
    blocking = graph.warnings.where(F.col("message") != NO_ANCHOR).select("slug").distinct().withColumn("_blocked", F.lit(True))
    mine = graph.nodes.where(F.col("id").isNotNull()).select("slug", "id").distinct()
    # The first and the last note that holds an anchor tell whether any other one does.
    theirs = node_rows(stored).where(F.col("id").isNotNull()).groupBy("id").agg(F.min("slug").alias("_first"), F.max("slug").alias("_last"))
    clash = mine.join(theirs, "id").where("slug <> _first OR slug <> _last").select("slug").distinct().withColumn("_clash", F.lit(True))
    joined = incoming.select("slug").join(blocking, "slug", "left").join(clash, "slug", "left")
    outcome = (
        F.when(F.col("_blocked") & F.lit(not force), "blocked").when(F.col("_clash"), "conflict").otherwise("accepted")
    )
    return joined.select("slug", outcome.alias("outcome"))
