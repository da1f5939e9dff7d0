"""A tree of files as rows: listings without hidden files, folders first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, folder, size, modified) of the files below path; names that begin with a dot are hidden. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    below = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return files.select(below.alias("name"), folder.alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~F.col("name").startswith("."))


def children(rows: DataFrame, folder: str) -> DataFrame:
    """One level of a listing: folders first, then by name."""
    inside = F.regexp_extract(F.col("folder"), "^" + r"\Q" + folder.rstrip("/") + r"\E" + "/([^/]+)", 1)
    here = rows.where(F.rtrim("folder", F.lit("/")) == folder.rstrip("/")).select("name", F.lit(False).alias("is_folder"), "size")
    below = rows.select(inside.alias("name")).where("name <> ''").distinct().select("name", F.lit(True).alias("is_folder"), F.lit(None).cast("bigint").alias("size"))
    return here.unionByName(below).orderBy(F.desc("is_folder"), "name")
