"""arXiv Atom feeds, read with Spark's XML source (one row per entry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.functions.columns import trim
from citegraph.functions.id_columns import alias_struct, arxiv_id
from citegraph.sources.emission import Emission, present

SOURCE = "arxiv"
ENTRY_SCHEMA = (
    "id string, updated string, published string, title string, summary string, author array<struct<name:string>>, "
    "`arxiv:primary_category` struct<_term:string>, category array<struct<_term:string>>, "
    "`arxiv:doi` struct<_VALUE:string>, link array<struct<_title:string,_href:string>>"
)
# Fields of the curated form, in order; the abstract only when asked for.
CURATED = ("arxiv_id", "title", "abstract", "authors", "published", "doi", "primary_category", "categories", "pdf_url")


def entries(feed: DataFrame) -> DataFrame:
    """(arxiv_id, title, abstract, authors, published, updated, primary_category, categories, doi, pdf_url) of raw entries."""
    pdf = F.filter("link", lambda l: (l["_title"] == "pdf") & (l["_href"] != ""))
    return feed.select(
        arxiv_id(F.col("id")).alias("arxiv_id"), trim(F.regexp_replace("title", r"(?U)\s+", " ")).alias("title"),
        trim(F.col("summary")).alias("abstract"),
        F.filter("author", lambda a: a["name"] != "").alias("authors"), "published", "updated",
        F.col("`arxiv:primary_category`._term").alias("primary_category"), F.transform("category", lambda c: c["_term"]).alias("categories"),
        trim(F.col("`arxiv:doi`._VALUE")).alias("doi"), F.element_at(F.when(F.size(pdf) > 0, pdf), -1)["_href"].alias("pdf_url"),
    )


def aliases() -> Column:
    return present([alias_struct("arxiv", F.col("arxiv_id")), alias_struct("doi", F.nullif("doi", F.lit("")))])


def parse(feed: DataFrame, fetched_at: str) -> Emission:
    """Work records of raw entries; arXiv states no citations."""
    parsed = entries(feed)
    records = parsed.select(
        F.concat_ws(":", F.lit(SOURCE), "arxiv_id").alias("record_id"), F.lit(SOURCE).alias("source"), F.lit("work").alias("kind"),
        aliases().alias("aliases"), F.to_json(F.struct(*parsed.columns)).alias("attrs"), F.lit(fetched_at).alias("fetched_at"),
    )
    spark = feed.sparkSession
    edges = spark.createDataFrame([], "src struct<scheme:string,value:string>, dst struct<scheme:string,value:string>, relation string, source string, attrs string, fetched_at string")
    return Emission(records, edges, spark.createDataFrame([], "reason string, count bigint"))


def curate(parsed: DataFrame, include_abstract: bool = False) -> DataFrame:
    return parsed.select(*[c for c in CURATED if include_abstract or c != "abstract"])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path)


def read_arxiv(spark: SparkSession, path: str, fetched_at: str) -> Emission:
    return parse(read_feed(spark, path), fetched_at)
