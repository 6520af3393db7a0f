"""Search of titles and authors through an index of trigrams, without parsing a claim at query time.

`add` parses claims once and lays out, in parts that a lookup finds (`streaming.ledger`): the searchable texts, lower-cased,
by their id; for each run of three characters of a text a posting; how many texts have each trigram; and the years by value.
A query takes its needle's rarest trigram, reads that trigram's postings alone, reads those texts and keeps the
ones that contain the needle. A needle of one or two characters has no trigram: it is held against all texts,
which are plain columns. Answers equal those of `catalog.search_works`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegraph.functions.columns import char_runs
from citegraph.functions.ranking import smallest_rows
from citegraph.operators.catalog import search_fields
from citegraph.session import cut_lineage
from citegraph.streaming.ledger import FAN, PART_ROWS, Layout, Ledger

GRAM = 3
LAYOUTS = (
    Layout("texts", "text_id string, field string, text string, canonical_id string", ("text_id",), ("text_id",)),
    Layout("postings", "field string, gram string, text_id string", ("field", "gram", "text_id"), ("field", "gram")),
    # One row per trigram and batch; a text that comes again counts again, which only makes a trigram look more frequent.
    Layout("grams", "field string, gram string, added long, n long", ("field", "gram", "added"), ("field", "gram")),
    Layout("years", "year long, canonical_id string", ("year", "canonical_id"), ("year",)),
)


def grams_of(text: str) -> Column:
    """The different trigrams of a text column; none of a shorter text."""
    return char_runs(text, GRAM)


class TextIndex:
    """An index under `root`; `add` writes claims into it, `search_works` reads it."""

    def __init__(self, spark: SparkSession, root: str, part_rows: int = PART_ROWS, fan: int = FAN) -> None:
        self.ledger = Ledger(spark, root, LAYOUTS, part_rows, fan)

    def add(self, assertions: DataFrame) -> None:
        """Index claims (canonical_id, source, attrs, fetched_at); equal texts of a node are one."""
        # Claims are dealt out before they are parsed: a small file is one task, however many claims it holds.
        fields = cut_lineage(search_fields(assertions.repartition("canonical_id")))
        titles = fields.select("canonical_id", F.lit("title").alias("field"), F.explode(F.array("title", "display_name")).alias("text"))
        authors = fields.select("canonical_id", F.lit("author").alias("field"), F.explode("author_names").alias("text"))
        texts = titles.unionByName(authors).where(F.col("text").isNotNull()).withColumn("text", F.lower("text")).distinct()
        texts = cut_lineage(texts.withColumn("text_id", F.sha2(F.to_json(F.struct("canonical_id", "field", "text"), {"ignoreNullFields": "false"}), 256)))
        stays, added = F.lit(False).alias("gone"), self.ledger.manifest().batch + 1
        postings = texts.select("field", F.explode(grams_of("text")).alias("gram"), "text_id")
        deltas = {
            "texts": texts.select(*self.ledger.layouts["texts"].columns, stays),
            "postings": postings.select("*", stays),
            "grams": postings.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n")).select("field", "gram", F.lit(added).cast("long").alias("added"), "n", stays),
            "years": fields.where("year IS NOT NULL").select("year", "canonical_id").distinct().select("*", stays),
        }
        if self.ledger.commit(added, deltas):
            self.ledger.compact()

    def rarest(self, field: str, needle: str) -> tuple[str, int] | None:
        """The needle's trigram with the fewest postings, and how many those are; None if the needle is too short."""
        grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        if not grams:
            return None
        asked = self.ledger.spark.createDataFrame([(field, g) for g in grams], "field string, gram string")
        counts = self.ledger.lookup("grams", asked).groupBy("gram").agg(F.sum("n").alias("n"))
        found = {g: 0 for g in grams} | {r["gram"]: r["n"] for r in counts.collect()}  # a row per trigram of the needle
        return min(found.items(), key=lambda item: (item[1], item[0]))

    def candidates(self, field: str, needle: str) -> DataFrame:
        """(canonical_id, text) of the texts that hold the needle's rarest trigram, or of all where it has none."""
        rare = self.rarest(field, needle)
        if rare is None:
            return self.ledger.read("texts").where(F.col("field") == field).select("canonical_id", "text")
        asked = self.ledger.spark.createDataFrame([(field, rare[0])], "field string, gram string")
        return self.ledger.lookup("texts", self.ledger.lookup("postings", asked).select("text_id")).select("canonical_id", "text")

    def matches(self, field: str, needle: str) -> DataFrame:
        """(canonical_id) of nodes with a text that contains the needle, whatever the case."""
        wanted = needle.lower()
        return self.candidates(field, wanted).where(F.contains("text", F.lit(wanted))).select("canonical_id").distinct()

    def search_works(
        self, nodes: DataFrame, *, author: str | None = None, title: str | None = None, year: int | None = None,
        with_artifact: str | None = None, artifacts: DataFrame | None = None, limit: int | None = None,
    ) -> DataFrame:
        """As `catalog.search_works`: live works (canonical_id) that meet every filter."""
        spark, met = self.ledger.spark, []
        if author is not None:
            met.append(self.matches("author", author))
        if title is not None:
            met.append(self.matches("title", title))
        if year is not None:
            met.append(self.ledger.lookup("years", spark.createDataFrame([(year,)], "year long")).select("canonical_id").distinct())
        if with_artifact is not None:
            met.append(artifacts.where(F.col("is_current") & (F.col("role") == with_artifact)).select("canonical_id"))
        if not met:
            raise ValueError("search_works needs at least one filter")
        works = nodes.where((F.col("kind") == "work") & F.col("merged_into").isNull()).select("canonical_id")
        for found in met:
            works = works.join(found, "canonical_id", "left_semi")
        return works if limit is None else smallest_rows(works, ["canonical_id"], limit)
