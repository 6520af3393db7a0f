"""Semantic Scholar dumps: papers, authors, and citation or reference pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.functions.id_columns import alias_struct, bare_doi, strip_prefix
from citegraph.session import cut_lineage
from citegraph.sources.emission import Emission, present

SOURCE = "semanticscholar"
_PAPER_IDS = "externalIds:struct<DOI:string,ArXiv:string,MAG:string,PubMed:string,PubMedCentral:string,CorpusId:string>"
PAPER_SCHEMA = f"paperId string, {_PAPER_IDS.replace(':', ' ', 1)}"
#: What names the end of an edge.
_END_SCHEMA = "paperId string, externalIds struct<DOI:string>"
AUTHOR_SCHEMA = "authorId string, externalIds struct<ORCID:string>"

# Fields kept in the curated form; the abstract only when asked for.
CURATED_PAPER = (
    "paperId string, externalIds map<string,string>, title string, abstract string, year int, publicationDate string, venue string, "
    "citationCount bigint, referenceCount bigint, authors array<struct<authorId:string,name:string>>, openAccessPdf struct<url:string>"
)
CURATED_AUTHOR = (
    "authorId string, externalIds map<string,string>, name string, affiliations array<string>, paperCount bigint, citationCount bigint, hIndex int"
)


def paper_aliases(r: Column) -> Column:
    ids = r["externalIds"]
    return present(
        [
            alias_struct("s2", r["paperId"]), alias_struct("doi", bare_doi(ids["DOI"])), alias_struct("arxiv", ids["ArXiv"]),
            alias_struct("mag", ids["MAG"]), alias_struct("pmid", ids["PubMed"]), alias_struct("pmcid", ids["PubMedCentral"]),
            alias_struct("corpusid", ids["CorpusId"]),
        ]
    )


def author_aliases(r: Column) -> Column:
    return present(
        [
            alias_struct("s2author", r["authorId"]),
            alias_struct("orcid", strip_prefix(r["externalIds"]["ORCID"], r"\Ahttps://orcid\.org/")),
        ]
    )


def best_paper_alias(r: Column) -> Column:
    """The end of an edge: the DOI where there is one, so that it meets other providers, else the paper id, else null."""
    doi = bare_doi(r["externalIds"]["DOI"])
    return F.when(doi.isNotNull(), alias_struct("doi", doi)).when(r["paperId"].isNotNull(), alias_struct("s2", r["paperId"]))


def _records(lines: DataFrame, schema: str, kind: str, id_field: str, aliases, fetched_at: str) -> DataFrame:
    parsed = lines.select("value", F.from_json("value", schema).alias("r"))
    fallback = F.sha2("value", 256)
    return parsed.select(
        F.concat_ws(":", F.lit(SOURCE), F.coalesce(F.col(f"r.{id_field}"), fallback)).alias("record_id"), F.lit(SOURCE).alias("source"),
        F.lit(kind).alias("kind"), aliases(F.col("r")).alias("aliases"), F.col("value").alias("attrs"), F.lit(fetched_at).alias("fetched_at"),
    )


def paper_records(lines: DataFrame, fetched_at: str) -> DataFrame:
    return _records(lines, PAPER_SCHEMA, "work", "paperId", paper_aliases, fetched_at)


def author_records(lines: DataFrame, fetched_at: str) -> DataFrame:
    return _records(lines, AUTHOR_SCHEMA, "author", "authorId", author_aliases, fetched_at)


def parse_citation_pages(pages: DataFrame, role: str, fetched_at: str) -> Emission:
    """Records and edges of citation pages (seed JSON, value JSON page); `role` is citingPaper or citedPaper.

    An end without DOI or paper id is quarantined (counted under `unknown_endpoint`): joined
    under one made-up id such papers would become a single hub.
    """
    if role not in ("citingPaper", "citedPaper"):
        raise ValueError("role must be citingPaper or citedPaper")
    page_schema = f"data array<struct<{role}:string>>"
    # A page and a paper are parsed once: each alias is the element of an array that is exploded, which no filter is
    # pushed through and no projection repeats. The seed is parsed before its page is taken apart.
    once = lambda column: F.explode(F.array(column))
    seeds = pages.select(once(best_paper_alias(F.from_json("seed", _END_SCHEMA))).alias("seed_alias"), "value")
    items = seeds.select("seed_alias", F.explode(F.from_json("value", page_schema)["data"]).alias("d")).select(
        "seed_alias", F.col(f"d.{role}").alias("value")
    ).where(F.col("value").isNotNull())
    ends = items.select("seed_alias", once(F.from_json("value", _END_SCHEMA)).alias("paper")).select(
        "seed_alias", once(best_paper_alias(F.col("paper"))).alias("other_alias")
    )
    # Edges and the count of what is skipped read the written ends.
    ends = cut_lineage(ends)
    src, dst = ("other_alias", "seed_alias") if role == "citingPaper" else ("seed_alias", "other_alias")
    known = F.col("seed_alias").isNotNull() & F.col("other_alias").isNotNull()
    edges = ends.where(known).select(
        F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit("cites").alias("relation"), F.lit(SOURCE).alias("source"),
        F.lit(None).cast("string").alias("attrs"), F.lit(fetched_at).alias("fetched_at"),
    )
    skipped = ends.where(~known).agg(F.count(F.lit(1)).alias("count")).select(F.lit("unknown_endpoint").alias("reason"), "count")
    return Emission(paper_records(items.select("value"), fetched_at), edges, skipped)


def read_semanticscholar(spark: SparkSession, papers: str, authors: str | None, fetched_at: str) -> Emission:
    read = lambda path: spark.read.option("recursiveFileLookup", "true").text(path)
    records = paper_records(read(papers), fetched_at)
    if authors is not None:
        records = records.unionByName(author_records(read(authors), fetched_at))
    none = spark.createDataFrame([], "src struct<scheme:string,value:string>, dst struct<scheme:string,value:string>, relation string, source string, attrs string, fetched_at string")
    return Emission(records, none, spark.createDataFrame([], "reason string, count bigint"))


def curate(lines: DataFrame, schema: str = CURATED_PAPER, include_abstract: bool = False) -> DataFrame:
    r = F.from_json("value", schema)
    if schema == CURATED_PAPER and not include_abstract:
        r = r.dropFields("abstract")
    return lines.select(F.to_json(r).alias("value"))
