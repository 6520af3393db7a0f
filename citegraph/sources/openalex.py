"""OpenAlex dumps: one JSON record per line, entity told from the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.functions.columns import let, trim
from citegraph.functions.id_columns import alias_struct, bare_doi, bare_openalex, openalex_entity, strip_prefix
from citegraph.sources.emission import Emission, present

SOURCE = "openalex"

# The node kind of each mapped entity; other entities are skipped.
NODE_KINDS = {"works": "work", "authors": "author", "sources": "venue", "topics": "topic", "concepts": "concept"}

ALIAS_SCHEMA = (
    "id string, orcid string, issn_l string, issn array<string>, wikidata string, referenced_works array<string>, "
    "ids struct<doi:string,pmid:string,pmcid:string,mag:string>"
)

_AUTHORSHIP = (
    "struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,"
    "institutions:array<struct<id:string,display_name:string,country_code:string>>>"
)
_IDS = "ids map<string,string>"
# Fields kept of each entity in the curated form.
CURATED = {
    "works": "id string, doi string, title string, display_name string, publication_year int, publication_date string, "
    "type string, cited_by_count bigint, open_access struct<is_oa:boolean,oa_status:string,oa_url:string,any_repository_has_fulltext:boolean>, "
    f"authorships array<{_AUTHORSHIP}>, "
    "primary_location struct<is_oa:boolean,is_accepted:boolean,is_published:boolean,pdf_url:string,"
    "source:struct<id:string,display_name:string,issn_l:string,is_oa:boolean>>, "
    f"primary_topic struct<id:string,display_name:string>, language string, {_IDS}",
    "authors": "id string, orcid string, display_name string, display_name_alternatives array<string>, works_count bigint, "
    f"cited_by_count bigint, summary_stats string, last_known_institutions string, {_IDS}",
    "sources": "id string, issn_l string, issn array<string>, display_name string, type string, is_oa boolean, is_in_doaj boolean, "
    f"works_count bigint, cited_by_count bigint, country_code string, {_IDS}",
    "institutions": f"id string, ror string, display_name string, country_code string, type string, works_count bigint, cited_by_count bigint, {_IDS}",
    "topics": "id string, display_name string, description string, subfield string, field string, domain string, works_count bigint, cited_by_count bigint",
    "keywords": "id string, display_name string, works_count bigint, cited_by_count bigint",
    "publishers": f"id string, display_name string, works_count bigint, cited_by_count bigint, country_codes array<string>, hierarchy_level int, {_IDS}",
    "funders": f"id string, display_name string, works_count bigint, cited_by_count bigint, country_code string, description string, {_IDS}",
    "concepts": "id string, display_name string, level int, description string, works_count bigint, cited_by_count bigint",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) one JSON record per row; directories are read recursively, compressed files as well."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(value) records of list pages `{meta, results: […]}`."""
    pages = read_lines(spark, path).select(F.from_json("value", "results array<string>").alias("p"))
    return pages.select(F.explode("p.results").alias("value"))


def aliases(entity: Column, r: Column) -> Column:
    """Aliases of a parsed record (struct column `r`), addresses stripped to bare ids."""
    own = alias_struct("openalex", bare_openalex(r["id"]))
    wikidata = strip_prefix(r["wikidata"], r"\Ahttps://www\.wikidata\.org/(?:wiki|entity)/")
    issns = F.transform(F.coalesce(r["issn"], F.array().cast("array<string>")), lambda i: alias_struct("issn", i))
    return (
        F.when(
            entity == "works",
            present([own, alias_struct("doi", bare_doi(r["ids"]["doi"])), *[alias_struct(s, r["ids"][s]) for s in ("pmid", "pmcid", "mag")]]),
        )
        .when(entity == "authors", present([own, alias_struct("orcid", strip_prefix(r["orcid"], r"\Ahttps://orcid\.org/"))]))
        .when(entity == "sources", F.concat(present([own, alias_struct("issn_l", r["issn_l"])]), F.filter(issns, lambda i: i["value"].isNotNull())))
        .when(entity == "topics", present([own]))
        .when(entity == "concepts", present([own, alias_struct("wikidata", wikidata)]))
    )


def parse(lines: DataFrame, fetched_at: str) -> Emission:
    """Records, outgoing `cites` edges and skipped counts of (value) JSON lines."""
    kinds = F.create_map(*[F.lit(x) for pair in NODE_KINDS.items() for x in pair])
    typed = lines.select("value", F.from_json("value", ALIAS_SCHEMA).alias("r")).withColumn("e", openalex_entity(F.col("r.id")))
    mapped = typed.withColumn("kind", F.element_at(kinds, F.col("e.entity")))
    records = mapped.where(F.col("kind").isNotNull()).select(
        F.concat_ws(":", F.lit(SOURCE), F.col("e.id")).alias("record_id"), F.lit(SOURCE).alias("source"), "kind",
        aliases(F.col("e.entity"), F.col("r")).alias("aliases"), F.col("value").alias("attrs"), F.lit(fetched_at).alias("fetched_at"),
    )
    cited = typed.where("e.entity = 'works'").select(F.col("r.id").alias("citing"), F.explode("r.referenced_works").alias("cited"))
    skipped = mapped.where(F.col("kind").isNull()).groupBy(F.coalesce("e.entity", F.lit("unknown")).alias("reason")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return Emission(records, cites_edges(cited, fetched_at), skipped)


def cites_edges(pairs: DataFrame, fetched_at: str) -> DataFrame:
    """`cites` edges from (citing, cited) ids, which may be addresses."""
    end = lambda c: alias_struct("openalex", bare_openalex(F.col(c)))
    return pairs.select(
        end("citing").alias("src"), end("cited").alias("dst"), F.lit("cites").alias("relation"), F.lit(SOURCE).alias("source"),
        F.lit(None).cast("string").alias("attrs"), F.lit(fetched_at).alias("fetched_at"),
    )


def citing_pairs(results: DataFrame) -> DataFrame:
    """(citing, cited) from the results of `cited-by` requests: (cited, value JSON of the citing work)."""
    return results.select(F.get_json_object("value", "$.id").alias("citing"), "cited").where(F.col("citing").isNotNull())


def read_openalex(spark: SparkSession, path: str, fetched_at: str) -> Emission:
    return parse(read_lines(spark, path), fetched_at)


def curate(lines: DataFrame, entity: str) -> DataFrame:
    """(value) trimmed to the curated fields. The schema is the allowlist; fields without a value are left out."""
    return lines.select(F.to_json(F.from_json("value", CURATED[entity])).alias("value"))


def reconstruct_abstract(index: Column, keep_gaps: bool = True) -> Column:
    """Text of an inverted index MAP<word, ARRAY<position>>, null when it is empty. Row-local.

    Every position up to the last is a word; one that no word claims is empty, one that several
    claim takes the last by name. `keep_gaps=False` strings the claimed words together instead.
    """
    claims = F.array_sort(
        F.flatten(
            F.transform(
                F.map_entries(index),
                lambda e: F.transform(e["value"], lambda p: F.struct(p.cast("int").alias("at"), e["key"].alias("word"))),
            )
        )
    )
    if not keep_gaps:
        return F.when(F.size(claims) > 0, F.array_join(F.transform(claims, lambda c: c["word"]), " "))
    placed = let(claims, lambda all_: F.filter(all_, lambda c, i: F.coalesce(F.get(all_, i + 1)["at"] != c["at"], F.lit(True))))

    def spaced(all_: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(all_, i - 1)["at"]).otherwise(F.lit(0))
        return F.array_join(F.transform(all_, lambda c, i: F.concat(F.repeat(F.lit(" "), c["at"] - before(i)), c["word"])), "")

    text = trim(let(placed, spaced))
    return F.when(text != "", text)


def oa_url(work: Column) -> Column:
    """First non-empty open-access address of a work's attributes (JSON text)."""
    paths = ("$.primary_location.pdf_url", "$.open_access.oa_url", "$.best_oa_location.pdf_url")
    return F.coalesce(*[F.nullif(F.get_json_object(work, p), F.lit("")) for p in paths])


def unpaywall_url(answer: Column) -> Column:
    paths = ("$.best_oa_location.url_for_pdf", "$.best_oa_location.url")
    return F.coalesce(*[F.nullif(F.get_json_object(answer, p), F.lit("")) for p in paths])


def to_fetch(works: DataFrame, unpaywall: DataFrame) -> DataFrame:
    """(canonical_id, url, url_source): where each work's text can be had, by its own attributes, else by DOI.

    `works`: canonical_id, attrs, doi. `unpaywall`: doi, answer (JSON). Nothing is downloaded here.
    """
    own = works.select("canonical_id", "doi", oa_url(F.col("attrs")).alias("_own"))
    other = unpaywall.select("doi", unpaywall_url(F.col("answer")).alias("_other"))
    joined = own.join(other, "doi", "left")
    url = F.coalesce("_own", "_other")
    source = F.when(F.col("_own").isNotNull(), SOURCE).when(F.col("_other").isNotNull(), "unpaywall")
    return joined.select("canonical_id", url.alias("url"), source.alias("url_source")).where(F.col("url").isNotNull())


SUMMARY_SCHEMA = (
    "id string, canonical_id string, display_name string, title string, name string, publication_year int, cited_by_count bigint, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, "
    "attrs struct<title:string>"
)


def summarize(lines: DataFrame) -> DataFrame:
    """(id, title, label, year, authors, venue, cited_by_count) of works; `label` is the best name the record gives."""
    r = F.from_json("value", SUMMARY_SCHEMA)
    names = F.transform("r.authorships", lambda a: a["author"]["display_name"])
    return lines.select(r.alias("r")).select(
        F.coalesce("r.canonical_id", "r.id").alias("id"),
        F.coalesce("r.display_name", "r.title", "r.attrs.title").alias("title"),
        F.coalesce("r.title", "r.display_name", "r.name").alias("label"),
        F.col("r.publication_year").alias("year"),
        F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "")).alias("authors"),
        F.col("r.primary_location.source.display_name").alias("venue"), F.col("r.cited_by_count").alias("cited_by_count"),
    )
