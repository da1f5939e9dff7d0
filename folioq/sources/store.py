"""Tables of documents, chapters and candidates in Parquet: upsert by key, read, delete, bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from folioq.operators.merge import latest


class Table:
    """Rows by key, written as versions: an upsert appends, a read takes each key's newest, compaction rewrites.

    A delete appends a tombstone. Appends are atomic per write, so a lost executor leaves no half of one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def _versions(self) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("_version", "long").add("_deleted", "boolean")
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return latest(self._versions(), self.keys, ["_version"]).where("NOT _deleted").select(*self.schema.names)

    def upsert(self, rows: DataFrame, version: int) -> None:
        rows.select(*self.schema.names, F.lit(version).cast("bigint").alias("_version"), F.lit(False).alias("_deleted")).write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame, version: int) -> None:
        gone = self.read().join(keys.select(*self.keys), self.keys, "left_semi")
        gone.select(*self.schema.names, F.lit(version).cast("bigint").alias("_version"), F.lit(True).alias("_deleted")).write.mode("append").parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Everything out, these rows in."""
        rows.select(*self.schema.names, F.lit(0).cast("bigint").alias("_version"), F.lit(False).alias("_deleted")).write.mode("overwrite").parquet(self.path)

    def copy(self, other: Table, version: int) -> None:
        other.upsert(self.read(), version)


def bundle(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, row): several tables as JSON rows, for a backup."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def unbundled(rows: DataFrame, name: str, schema: StructType | str) -> DataFrame:
    return rows.where(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*")


def cached_counts(books: DataFrame, chapters: DataFrame, cache: DataFrame) -> DataFrame:
    """Books with how many of their chapters are cached."""
    n = chapters.join(cache.select("bookUrl", "url").distinct(), ["bookUrl", "url"], "left_semi").groupBy("bookUrl").agg(F.count("*").alias("cachedChapterCount"))
    rows = books.join(n, "bookUrl", "left")
    local = F.col("bookUrl").startswith("local-")
    return rows.withColumn("cachedChapterCount", F.when(local, F.lit(0)).otherwise(F.coalesce("cachedChapterCount", F.lit(0))).cast("bigint"))
