"""Bytes to text: what the caller says, the content type, the page's own meta tag, else UTF-8."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioq.operators.batches import sliced

_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)", re.I)
_WIDER = {"gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "utf8": "utf-8"}


def named(body: bytes, given: str | None = None, content_type: str | None = None) -> str:
    found = given or (m[1] if (m := re.search(r"charset\s*=\s*[\"']?([\w-]+)", content_type or "", re.I)) else None)
    if not found and (m := _META.search(body[:4096])):
        found = m[1].decode()
    name = (found or "utf-8").strip().lower()
    return _WIDER.get(name, name)


def decoded(body: bytes, given: str | None = None, content_type: str | None = None) -> str:
    try:
        return body.decode(named(body, given, content_type), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def text_decoded(raw: bytes) -> str:
    """A plain-text file: UTF-8 with or without its mark, else GB18030."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "replace")


def with_text(df: DataFrame, body: str, out: str = "text", given: str | None = None, content_type: str | None = None, plain: bool = False) -> DataFrame:
    """df with the text of a binary column; given and content_type name columns."""
    names, at = [*df.columns, out], [df.columns.index(c) if c else None for c in (body, given, content_type)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols = [batch.column(k).to_pylist() if k is not None else [None] * batch.num_rows for k in at]
            texts = [None if b is None else text_decoded(b) if plain else decoded(b, g, c) for b, g, c in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(made, StructType([*df.schema.fields, StructField(out, StringType())]))


def as_hex(body: Column) -> Column:
    return F.lower(F.hex(body))


def with_prolog(body: Column, content_type: Column, url: Column) -> Column:
    """Feeds and XML get the prolog that parsers want, if they have none."""
    xml = F.lower(content_type).rlike("xml|rss|atom") | F.lower(url).rlike(r"\.(xml|rss|atom)(\?|$)|/feed")
    return F.when(xml & ~F.ltrim(body).startswith("<?xml"), F.concat(F.lit('<?xml version="1.0"?>'), body)).otherwise(body)
