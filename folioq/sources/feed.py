"""RSS and Atom feeds to article rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioq.operators.batches import sliced

FIELDS = ("title", "link", "description", "content", "pubDate", "image")


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def when(text: str | None) -> datetime | None:
    for read in (lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            got = read((text or "").strip())
            return got if got.tzinfo else got.replace(tzinfo=timezone.utc)
        except (ValueError, TypeError, IndexError):
            continue
    return None


def articles(xml: str) -> Iterator[dict]:
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return
    for e in root.iter():
        if _name(e) not in ("item", "entry"):
            continue
        text = lambda *names: next((t for n in names for c in e if _name(c) == n and (t := "".join(c.itertext()).strip())), None)  # noqa: B023, E731
        link = next((c.get("href") for c in e if _name(c) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"), None) or text("link")
        image = next((c.get("url") for c in e.iter() if _name(c) in ("thumbnail", "content") and c.get("url")), None) or next((c.get("url") for c in e if _name(c) == "enclosure" and (c.get("type") or "").startswith("image/")), None)
        at = when(text("published", "pubDate", "date")) or when(text("updated"))
        yield {"title": text("title"), "link": link, "description": text("description", "summary"), "content": text("encoded", "content"), "pubDate": at.isoformat() if at else None, "image": image, "order": int(at.timestamp()) if at else None}


def read(responses: DataFrame, body: str = "body", origin: str = "origin", now: int = 0) -> DataFrame:
    """(origin, seq, ...): the entries of every feed; an entry without a time is ordered at `now`."""
    schema = StructType([responses.schema[origin], StructField("seq", LongType()), *(StructField(f, StringType()) for f in FIELDS), StructField("order", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, feeds, seqs = [], [], []
            for k, xml in enumerate(batch.column(1).to_pylist()):
                some = list(articles(xml or ""))
                found += some
                feeds += [k] * len(some)
                seqs += range(len(some))
            cols = [pa.array([r[f] for r in found], pa.string()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(feeds, pa.int32())), pa.array(seqs, pa.int64()), *cols, pa.array([r["order"] if r["order"] is not None else now for r in found], pa.int64())], names=schema.names)

    return responses.select(origin, body).mapInArrow(rows, schema)


def newest(rows: DataFrame, size: int = 50, page: int = 1) -> DataFrame:
    """A page of all feeds' articles, newest first."""
    from folioq.operators.windows import page as paged

    return paged(rows, ["origin"], [F.desc("order"), F.col("seq")], page, size)


def readable(content: Column) -> Column:
    """An article's content without scripts; nothing where it is a whole page."""
    whole = F.lower(content).rlike(r"^\s*(<!doctype html|<html\b)")
    return F.when(whole, F.lit("")).otherwise(F.regexp_replace(content, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", ""))
