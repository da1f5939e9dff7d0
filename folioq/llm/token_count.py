"""Token counts with overlap resynchronisation.

An ordinary text is encoded in one piece. A huge one is encoded in chunks that overlap; two neighbours are spliced
behind a token that both give at the same place, which is proven stable: every pair of neighbouring tokens of the
splice then stands in one of the two encodings, and a sequence of which all neighbouring pairs can stand together is
the whole text's encoding (see pieces.Spans.fits). Where the neighbours share no token, their overlap doubles, up to
the whole chunk; where even that shares none, the text is encoded in one piece.

A null text counts as empty: no bytes, no tokens. Repeated rows are counted one by one. Columns of the input that have
an output's name give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from folioq.llm.common import table, without
from folioq.llm.pieces import Spans, default_model, model, spans

HUGE, CHUNK, OVERLAP, LIMIT = 49_152, 16_384, 64, 4096


def spliced_count(s: Spans, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text that starts with its begin mark already."""
    text = text.replace(" ", "▁")
    n, lo, cut, total = len(text), 0, 0, 0  # tokens that start before cut are counted
    ids, at = s.encode(text[: min(n, chunk + overlap)])
    for b in range(chunk, n, chunk):
        wide = overlap
        while True:
            start = max(b - wide, lo)
            new_ids, new_at = s.encode(text[start : min(n, b + chunk + overlap)])
            new_at += start
            if (found := _common(s, ids, at, new_ids, new_at, start, cut)) is not None:
                break
            if start == lo:  # the overlap can't grow any more
                return len(s.encode(text)[0])
            wide *= 2
        total += int(((at >= cut) & (at < found)).sum())
        ids, at, lo, cut = new_ids, new_at, start, found
    return total + int((at >= cut).sum())


def _common(s: Spans, left, left_at, right, right_at, lo: int, done: int) -> int | None:
    """Where the last token ends that both encodings have at the same place and that starts behind lo and done."""
    keep_l, keep_r = ~s.is_byte[left] & (left_at > max(lo, done)), ~s.is_byte[right] & (right_at > lo)
    key = lambda ids, at: at * (len(s.pieces) + 1) + ids
    both = np.intersect1d(key(left[keep_l], left_at[keep_l]), key(right[keep_r], right_at[keep_r]))
    if not len(both):
        return None
    at, i = divmod(int(both[len(both) // 2]), len(s.pieces) + 1)
    return at + int(s.length[i])


def count(texts: list[str], path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    small = [t if len(t) <= huge else "" for t in texts]
    out = [len(ids) for ids in model(path).encode(small, num_threads=1)]
    for k, t in enumerate(texts):
        if len(t) > huge:
            out[k] = spliced_count(spans(path), "▁" + t, chunk, overlap)
    return out


def token_counts(df: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df's columns but the text, with n_bytes, n_tokens and over_limit. One pass, no shuffle; memory: a batch of rows and one chunk."""
    path = path or default_model()
    rest = without(df.drop(text), "n_bytes", "n_tokens", "over_limit").columns
    schema = StructType([*(df.schema[c] for c in rest), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column(len(rest)).to_pylist()]
                n = count(texts, path, huge, chunk, overlap)
                new = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *new], names=[*rest, "n_bytes", "n_tokens", "over_limit"])

    return df.select(*[f"`{c}`" for c in rest], f"`{text}`").mapInArrow(counted, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
