"""Hand-entered records, validated; bad rows go to a rejects table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SOURCE = "manual"
SCHEMA = "aliases array<string>, title string, authors array<string>, year int, kind string"
# Node kinds.
KINDS = ("work", "author", "venue", "concept", "topic")


def validate(rows: DataFrame, fetched_at: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of rows (aliases ARRAY<scheme:value>, title, authors, year, kind).

    A kind is matched whatever its case; an alias without a colon or an unknown kind rejects the row.
    """
    bad_alias = F.get(F.filter("aliases", lambda a: ~F.contains(a, F.lit(":"))), F.lit(0))
    reason = (
        F.when(~F.coalesce(F.lower("kind").isin(*KINDS), F.lit(False)), F.concat(F.lit("invalid kind '"), F.coalesce("kind", F.lit("")), F.lit("'")))
        .when(bad_alias.isNotNull(), F.concat(F.lit("invalid alias '"), bad_alias, F.lit("'")))
    )
    checked = rows.withColumn("reason", reason)
    split = r"(?s)\A([^:]*):(.*)\z"
    alias = lambda a: F.struct(F.regexp_extract(a, split, 1).alias("scheme"), F.regexp_extract(a, split, 2).alias("value"))
    authors = F.when(F.size("authors") > 0, F.col("authors"))
    attrs = F.to_json(F.struct("title", authors.alias("authors"), F.col("year").alias("publication_year")))
    records = checked.where(F.col("reason").isNull()).select(
        F.concat_ws(":", F.lit(SOURCE), F.sha2(F.concat_ws("\u001f", F.array_join("aliases", "\u001e"), attrs), 256)).alias("record_id"),
        F.lit(SOURCE).alias("source"), F.lower("kind").alias("kind"), F.transform("aliases", alias).alias("aliases"), attrs.alias("attrs"),
        F.lit(fetched_at).alias("fetched_at"),
    )
    return records, checked.where(F.col("reason").isNotNull())


def read_manual(spark: SparkSession, path: str, fetched_at: str) -> tuple[DataFrame, DataFrame]:
    return validate(spark.read.schema(SCHEMA).json(path), fetched_at)
