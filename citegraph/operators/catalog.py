"""Reading the catalog: merged views with provenance, search, filters, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.functions.ranking import best_row, smallest_rows
from citegraph.session import cut_lineage

# Filter keys answered by columns of a local works table.
WORK_FILTER_KEYS = ("title", "publication_year", "type", "language", "cited_by_count", "doi", "is_oa", "concepts.id")


# ── assertions ───────────────────────────────────────────────────────────────


def upsert_assertions(claims: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Last write per (node, provider). The write order (`seq`) decides, whatever the timestamps say."""
    return best_row(claims, ["canonical_id", "source"], list(order) if order else [F.desc("seq")])


def _keep_last_key(df: DataFrame) -> None:
    """JSON objects that repeat a key keep its last value; without this setting they would not parse at all."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def assertion_rejects(assertions: DataFrame) -> DataFrame:
    """The assertions whose `attrs` is no JSON: they state no field, and must not vanish unseen."""
    _keep_last_key(assertions)
    return assertions.where(F.col("attrs").isNotNull() & F.try_parse_json("attrs").isNull())


def reject_counts(assertions: DataFrame) -> DataFrame:
    """(source, rejects) per provider that has any."""
    return assertion_rejects(assertions).groupBy("source").agg(F.count(F.lit(1)).alias("rejects"))


def assertion_fields(assertions: DataFrame) -> DataFrame:
    """(canonical_id, key, value, source, fetched_at): one row per stated field, value as JSON text.

    An explicit JSON null is a value; of equal keys the last counts. Attributes that are not an object state nothing;
    those that are no JSON are in `assertion_rejects`.
    """
    _keep_last_key(assertions)
    as_map = F.expr("try_variant_get(try_parse_json(attrs), '$', 'map<string,variant>')")
    stated = assertions.select("canonical_id", "source", "fetched_at", F.explode(as_map).alias("key", "variant"))
    return stated.select("canonical_id", "key", F.to_json("variant").alias("value"), "source", "fetched_at")


def merge_assertions(assertions: DataFrame, cast_time: bool = False) -> DataFrame:
    """(canonical_id, key, value, source, fetched_at): the winning claim per field.

    Newest `fetched_at` wins, a tie goes to the smallest provider name. Times compare as
    text, as stored; `cast_time` compares them as instants instead.
    """
    newest = F.col("fetched_at").cast("timestamp") if cast_time else F.col("fetched_at")
    return best_row(assertion_fields(assertions), ["canonical_id", "key"], [newest.desc(), "source", "value"])


def nest_fields(merged: DataFrame) -> DataFrame:
    """One row per node: `attrs` MAP<key, JSON text> and `provenance` MAP<key, STRUCT<source, fetched_at>>."""
    by_key = F.array_sort(F.collect_list(F.struct("key", "value", "source", "fetched_at")))
    rows = merged.groupBy("canonical_id").agg(by_key.alias("fields"))
    return rows.select(
        "canonical_id",
        F.map_from_entries(F.transform("fields", lambda f: F.struct(f["key"], f["value"]))).alias("attrs"),
        F.map_from_entries(
            F.transform(
                "fields",
                lambda f: F.struct(f["key"], F.struct(f["source"].alias("source"), f["fetched_at"].alias("fetched_at"))),
            )
        ).alias("provenance"),
    )


def work_views(
    nodes: DataFrame, assertions: DataFrame, aliases: DataFrame, artifacts: DataFrame | None = None
) -> DataFrame:
    """Long form of a node's view: (canonical_id, kind, part, key, value, source, fetched_at).

    `part` is `field`, `alias` or `artifact`, so a node with very many aliases stays many rows.
    `nest_fields` folds the fields of a node, whose number its own record bounds.
    """
    live = nodes.where(F.col("merged_into").isNull()).select("canonical_id", "kind")
    none = F.lit(None).cast("string")
    fields = merge_assertions(assertions).select(
        "canonical_id", F.lit("field").alias("part"), "key", "value", "source", "fetched_at"
    )
    named = aliases.select(
        "canonical_id", F.lit("alias").alias("part"), F.col("scheme").alias("key"), "value",
        none.alias("source"), none.alias("fetched_at"),
    )
    parts = fields.unionByName(named)
    if artifacts is not None:
        held = artifacts.where("is_current").select(
            "canonical_id", F.lit("artifact").alias("part"), F.col("role").alias("key"),
            F.col("version").cast("string").alias("value"), none.alias("source"), none.alias("fetched_at"),
        )
        parts = parts.unionByName(held)
    return live.join(parts, "canonical_id")


def views_by_alias(
    requested: DataFrame, nodes: DataFrame, assertions: DataFrame, aliases: DataFrame, artifacts: DataFrame | None = None
) -> DataFrame:
    """(scheme, value, canonical_id, kind, part, key, text, source, fetched_at): the views of the nodes that aliases (scheme, value) name.

    Any alias of a node will do, those of nodes merged into it too; unknown ones give nothing. `text` is the JSON of a field, the
    value of an alias, and for an artifact the JSON of its whole descriptor. Only the claims of nodes asked for are parsed.
    """
    from citegraph.operators.identity import ALIAS_KEY, lookup, resolve_live

    live = resolve_live(nodes)
    found = cut_lineage(lookup(requested.select(*ALIAS_KEY).distinct(), aliases, live).where("is_known").select(*ALIAS_KEY, F.col("live_id").alias("canonical_id")))
    ids = found.select("canonical_id").distinct()
    asked = lambda table: table.join(ids, "canonical_id", "left_semi")
    named = aliases.join(live, "canonical_id").select(*ALIAS_KEY, F.col("live_id").alias("canonical_id"))
    views = work_views(asked(nodes), asked(assertions), asked(named)).withColumnRenamed("value", "text")
    if artifacts is not None:
        current = asked(artifacts.where("is_current"))
        described = F.to_json(F.struct(*[c for c in artifacts.columns if c not in ("canonical_id", "role")]))
        none = F.lit(None).cast("string")
        held = current.select("canonical_id", F.lit("artifact").alias("part"), F.col("role").alias("key"), described.alias("text"), none.alias("source"), none.alias("fetched_at"))
        views = views.unionByName(asked(nodes).select("canonical_id", "kind").join(held, "canonical_id"))
    return found.join(views, "canonical_id").select(*ALIAS_KEY, "canonical_id", "kind", "part", "key", "text", "source", "fetched_at")


# ── search ───────────────────────────────────────────────────────────────────


def _text_at(document: Column, path: str) -> Column:
    """The string at `path` of a variant, null when it is missing or not a string."""
    at = F.try_variant_get(document, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(document, path, "string"))


def search_fields(assertions: DataFrame) -> DataFrame:
    """Typed search columns per assertion: title, display_name, year, author_names.

    Author names are read from author paths only, so an institution or a title never
    satisfies an author filter.
    """
    _keep_last_key(assertions)
    doc = F.col("_doc")
    listed = lambda path: F.coalesce(
        F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>")
    )
    authorships = F.flatten(
        F.transform(
            listed("$.authorships"),
            lambda a: F.array(_text_at(a, "$.author.display_name"), _text_at(a, "$.raw_author_name")),
        )
    )
    authors = F.flatten(F.transform(listed("$.authors"), lambda a: F.array(_text_at(a, "$"), _text_at(a, "$.name"))))
    year = F.try_variant_get(doc, "$.publication_year", "variant")
    parsed = assertions.withColumn("_doc", F.try_parse_json("attrs"))
    return parsed.select(
        "canonical_id",
        _text_at(doc, "$.title").alias("title"),
        _text_at(doc, "$.display_name").alias("display_name"),
        F.when(F.schema_of_variant(year) == "BIGINT", F.try_variant_get(doc, "$.publication_year", "bigint")).alias("year"),
        F.filter(F.concat(authorships, authors), lambda n: n.isNotNull()).alias("author_names"),
    )


def author_matches(needle: str) -> Column:
    return F.exists("author_names", lambda n: F.contains(F.lower(n), F.lit(needle.lower())))


def title_matches(needle: str) -> Column:
    wanted = F.lit(needle.lower())
    return (
        F.coalesce(F.contains(F.lower("title"), wanted), F.lit(False))
        | F.coalesce(F.contains(F.lower("display_name"), wanted), F.lit(False))
    )


def year_matches(year: int) -> Column:
    return F.coalesce(F.col("year") == year, F.lit(False))


def search_works(
    nodes: DataFrame,
    assertions: DataFrame,
    *,
    author: str | None = None,
    title: str | None = None,
    year: int | None = None,
    with_artifact: str | None = None,
    artifacts: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Live works (canonical_id) meeting every filter; different assertions may meet different filters.

    All predicates are folded in one pass: `bool_or` per filter and node, combined before
    the shuffle. The artifact filter is a semi-join ahead of the limit, so none is missed.
    """
    tests = {}
    if author is not None:
        tests["author"] = author_matches(author)
    if title is not None:
        tests["title"] = title_matches(title)
    if year is not None:
        tests["year"] = year_matches(year)
    if not tests and with_artifact is None:
        raise ValueError("search_works needs at least one filter")
    works = nodes.where((F.col("kind") == "work") & F.col("merged_into").isNull()).select("canonical_id")
    if tests:
        flags = search_fields(assertions).select("canonical_id", *[test.alias(name) for name, test in tests.items()])
        some = flags.where(" OR ".join(tests))
        met = some.groupBy("canonical_id").agg(*[F.bool_or(name).alias(name) for name in tests]).where(" AND ".join(tests))
        works = works.join(met.select("canonical_id"), "canonical_id", "left_semi")
    if with_artifact is not None:
        held = artifacts.where(F.col("is_current") & (F.col("role") == with_artifact)).select("canonical_id")
        works = works.join(held, "canonical_id", "left_semi")
    if limit is not None:
        works = smallest_rows(works, ["canonical_id"], limit)
    return works


def parse_filters(specs: Sequence[str], allowed: Sequence[str] = WORK_FILTER_KEYS) -> list[tuple[str, list[str]]]:
    """`key:value` specs to (key, values): split at the first colon, `|` between alternatives.

    Raises with every key that is not allowed.
    """
    parsed = []
    for spec in specs:
        key, colon, value = spec.partition(":")
        if not colon:
            raise ValueError(f"{spec!r} is no filter: a key, a colon and a value are wanted")
        parsed.append((key, value.split("|")))
    bad = [key for key, _ in parsed if key not in allowed]
    if bad:
        raise ValueError("no such column to filter by: " + ", ".join(bad))
    return parsed


def filter_works(works: DataFrame, specs: Sequence[str], allowed: Sequence[str] = WORK_FILTER_KEYS) -> DataFrame:
    """Works meeting all specs. A list column matches when one of its items does."""
    out = works
    for key, values in parse_filters(specs, allowed):
        column = key.replace(".", "_")
        if works.schema[column].dataType.typeName() == "array":
            out = out.where(F.arrays_overlap(column, F.array(*map(F.lit, values))))
        else:
            out = out.where(F.col(column).cast("string").isin(values))
    return out


# ── counts ───────────────────────────────────────────────────────────────────


def stats(nodes: DataFrame, assertions: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(metric, value) headline counts; redirects are counted apart, bytes over all versions."""
    described = assertions.select("canonical_id").distinct().withColumn("described", F.lit(True))
    live = F.col("merged_into").isNull()
    work = live & (F.col("kind") == "work")
    counted = nodes.join(described, "canonical_id", "left").agg(
        F.count_if(work).alias("works"),
        F.count_if(work & F.col("described")).alias("works_described"),
        F.count_if(work & F.col("described").isNull()).alias("works_stub"),
        F.count_if(live).alias("nodes_total"),
        F.count_if(~live).alias("merge_redirects"),
    )
    names = counted.columns
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m"))
    edge_rows = edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("edges_total").alias("metric"), "value")
    byte_rows = artifacts.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("value")).select(
        F.lit("library_bytes").alias("metric"), F.col("value").cast("long")
    )
    return rows.select("m.*").unionByName(edge_rows).unionByName(byte_rows)


def tallies(nodes: DataFrame, assertions: DataFrame, edges: DataFrame) -> DataFrame:
    """(dimension, key, count): live nodes by kind, edges by relation, assertions by provider."""

    def tally(df: DataFrame, dimension: str, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count")).select(
            F.lit(dimension).alias("dimension"), "key", "count"
        )

    return (
        tally(nodes.where(F.col("merged_into").isNull()), "kind", "kind")
        .unionByName(tally(edges, "relation", "relation"))
        .unionByName(tally(assertions, "source", "source"))
        .orderBy("dimension", F.desc("count"), "key")
    )


def without_alias(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Live nodes nobody can address."""
    return nodes.where(F.col("merged_into").isNull()).join(aliases, "canonical_id", "left_anti")


# ── counts at several levels ─────────────────────────────────────────────────

#: Relative standard error of a distinct count is about 1.04 / sqrt(2^LG_K).
LG_K = 14
LEVELS = (("kind", "source"), ("kind",), ("source",), ())


def claim_sketches(nodes: DataFrame, assertions: DataFrame) -> DataFrame:
    """(kind, source, claims, works SKETCH) of one snapshot: what later snapshots can be added to."""
    kinds = nodes.select("canonical_id", "kind")
    claimed = assertions.select("canonical_id", "source").join(kinds, "canonical_id")
    return claimed.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("claims"), F.hll_sketch_agg("canonical_id", F.lit(LG_K)).alias("works"))


def level_counts(sketches: DataFrame) -> DataFrame:
    """(level, kind, source, claims, works): sketches of any number of snapshots merged at each of `LEVELS`.

    `claims` is exact; `works` estimates the different nodes. `level` says which of kind and source a row is for.
    """
    keys = [[F.col(c) for c in level] for level in LEVELS]
    merged = sketches.groupingSets(keys, F.col("kind"), F.col("source")).agg(
        F.grouping_id().alias("level"), F.sum("claims").alias("claims"), F.hll_sketch_estimate(F.hll_union_agg("works")).alias("works")
    )
    return merged.select("level", "kind", "source", "claims", "works")
