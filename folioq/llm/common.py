"""What the operators of this subpackage share: the cluster's shared folder, written tables, column handling."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The class that every contract here splits words by: a space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master (driver and tasks on one machine) gets a folder of the application's; a cluster
    has none that all could read, so there it's an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/folioq-{spark.sparkContext.applicationId}"
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioq/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes what operators have written below the shared folder. For when no result is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folioq")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage, survives lost executors, computes df once.

    codec: how the files are compressed, if not as the session says; "zstd" for tables that hold whole texts.
    """
    path = fresh_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=64)
def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", path) else f"file://{path}")


def dropped(*tables: DataFrame | str) -> None:
    """Removes tables that `written` made, or folders, when nothing is to be read from them any more."""
    spark = SparkSession.getActiveSession()
    for t in tables:
        for path in [t] if isinstance(t, str) else sorted({f.rpartition("/")[0] for f in t.inputFiles()}):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collected(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffles of finished jobs: it removes their files when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> Iterator[None]:
    """While a job runs, Arrow batches of so many rows and bytes: whole texts are long, and a batch stands in memory several times."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where its files have fewer parts than there are cores: a small table may be one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def packed(df: DataFrame, by: str, name: str = "rows") -> DataFrame:
    """(by, rows: array of structs of the other columns): equal keys of an Arrow batch as one row.

    For joins on keys of which one may have very many rows: it then has a row for each batch instead, and `unpacked`
    after the join gives the rows back. An array is no larger than its batch.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, StructField, StructType

    rest = [c for c in df.columns if c != by]
    schema = StructType([df.schema[by], StructField(name, ArrayType(StructType([df.schema[c] for c in rest])))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            at = codes.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(codes.dictionary)))]).astype(np.int32)
            rows = batch.take(pa.array(order))
            structs = pa.StructArray.from_arrays(rows.columns[1:], names=rest)
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.ListArray.from_arrays(pa.array(cuts), structs)], names=[by, name])

    return df.select(by, *rest).mapInArrow(made, schema)


def unpacked(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.inline(name))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add: an input column of the same name gives way."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row: a lambda variable isn't inlined into its uses."""
    return F.transform(F.array(value), body)[0]
