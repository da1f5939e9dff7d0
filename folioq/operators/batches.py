"""What Python steps share: rows dealt out over all cores, and batches of a size that memory doesn't notice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The most rows and bytes that a Python step has as objects at once; fixed values.
ROWS, BYTES = 512, 4 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt out evenly: a small file is read by a few tasks, by one where it is one row group, however many rows it has."""
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, 24))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most ROWS rows and, beyond one row, about BYTES bytes."""
    for batch in batches:
        rows = max(1, min(ROWS, BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
