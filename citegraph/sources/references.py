"""Reference lists by DOI: Crossref works and OpenCitations answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.sources.emission import Emission, doi_edges

CROSSREF_SCHEMA = "message struct<DOI:string,reference:array<struct<DOI:string>>>"
OPENCITATIONS_SCHEMA = "array<struct<cited:string>>"
UNION_SOURCE = "crossref+opencitations"


def crossref_pairs(answers: DataFrame) -> DataFrame:
    """(citing, cited): one row per reference of (citing, value JSON); `cited` is lower-cased, null without a DOI."""
    refs = answers.select("citing", F.explode(F.from_json("value", CROSSREF_SCHEMA)["message"]["reference"]).alias("ref"))
    return refs.select("citing", F.lower("ref.DOI").alias("cited"))


def opencitations_pairs(answers: DataFrame) -> DataFrame:
    refs = answers.select("citing", F.explode(F.from_json("value", OPENCITATIONS_SCHEMA)).alias("ref"))
    return refs.select("citing", F.lower("ref.cited").alias("cited"))


def _emission(pairs: DataFrame, source: str, fetched_at: str) -> Emission:
    skipped = pairs.where(F.col("cited").isNull()).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("no_doi").alias("reason"), "count"
    )
    edges = doi_edges(pairs.where(F.col("cited").isNotNull()), source, fetched_at)
    records = pairs.sparkSession.createDataFrame([], "record_id string, source string, kind string, aliases array<struct<scheme:string,value:string>>, attrs string, fetched_at string")
    return Emission(records, edges, skipped)


def parse_crossref(answers: DataFrame, fetched_at: str) -> Emission:
    return _emission(crossref_pairs(answers), "crossref", fetched_at)


def parse_opencitations(answers: DataFrame, fetched_at: str) -> Emission:
    return _emission(opencitations_pairs(answers), "opencitations", fetched_at)


def union_references(crossref: DataFrame, opencitations: DataFrame, fetched_at: str) -> DataFrame:
    """Edges of both lists, each cited work once per citing one, under one provider label."""
    pairs = crossref.unionByName(opencitations).where(F.col("cited").isNotNull()).distinct()
    return doi_edges(pairs, UNION_SOURCE, fetched_at)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(citing, value) from JSON lines {"citing": doi, "answer": …}, the bulk form of one request per work."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.get_json_object("value", "$.citing").alias("citing"), F.get_json_object("value", "$.answer").alias("value"))


def read_crossref_refs(spark: SparkSession, path: str, fetched_at: str) -> Emission:
    return parse_crossref(read_answers(spark, path), fetched_at)


def read_opencitations_refs(spark: SparkSession, path: str, fetched_at: str) -> Emission:
    return parse_opencitations(read_answers(spark, path), fetched_at)
