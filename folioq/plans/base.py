"""How queries register: a name, a function of the session and the tables' folder, and SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


#: Tables of long texts: what is done to a row takes longer than to deal it out.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; long texts are dealt out over all cores where their files have fewer parts than there are cores."""
    df, cores = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df
