"""Reading note files from a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SUFFIX = ".l3.md"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(slug, text, path) of every note under `path`, each file whole."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").text(path, wholetext=True)
    return select_notes(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), path)


def select_notes(files: DataFrame, root: str) -> DataFrame:
    """(slug, text, path) of the notes among (path, text): files named `*.l3.md`, those whose name, or a folder of
    theirs below `root`, begins with `_` left out."""
    inside = F.substring_index("path", root.rstrip("/") + "/", -1)
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"(?:\.l3\.md)+$", "")
    kept = files.where(F.endswith(name, F.lit(SUFFIX)) & ~F.rlike(inside, F.lit("(?:^|/)_")))
    return kept.select(F.url_decode(stem).alias("slug"), "text", "path")
