"""Rule sets over tables of stored responses: one parse per row, only the asked fields come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from folioq.dom.tree import parse
from folioq.operators.batches import sliced
from folioq.rules import evaluate, extract

CHAPTER = StructType([StructField("index", IntegerType()), StructField("title", StringType()), StructField("url", StringType()), StructField("tag", StringType()), *(StructField(k, BooleanType()) for k in ("isVolume", "isVip", "isPay"))])


def mapped(df: DataFrame, body: str, base: str | None, out: str, kind: DataType, of: Callable[[str, str], object]) -> DataFrame:
    """df with column `out` = of(body, base), row by row in small Arrow batches; null bodies count as empty."""
    names, at = [*df.columns, out], (df.columns.index(body), df.columns.index(base) if base else None)
    arrow = to_arrow_type(kind)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bodies = batch.column(at[0]).to_pylist()
            bases = batch.column(at[1]).to_pylist() if at[1] is not None else [""] * len(bodies)
            values = [of(b or "", u or "") for b, u in zip(bodies, bases)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=names)

    return df.mapInArrow(made, StructType([*df.schema.fields, StructField(out, kind)]))


def _exploded(df: DataFrame, column: str, keep: list[str], reverse: bool = False) -> DataFrame:
    items = F.reverse(column) if reverse else F.col(column)
    return df.select(*keep, F.posexplode(items).alias("seq", "_i")).select(*keep, "seq", "_i.*")


def chapter_rows(pages: DataFrame, rules: Mapping[str, str], body: str = "html", base: str = "url", keep: tuple[str, ...] = ("page_id",), scripts: Mapping[str, evaluate.Script] | None = None) -> DataFrame:
    """The chapters of every page: in order, each URL once."""
    of = lambda b, u: evaluate.chapters(b, u, rules, scripts)[0]
    return _exploded(mapped(pages.select(*keep, body, base), body, base, "_r", ArrayType(CHAPTER), of), "_r", list(keep)).drop("seq")


def item_rows(pages: DataFrame, list_rule: str, fields: Mapping[str, str], body: str = "html", base: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A list rule's items with the fields asked for, and their place."""
    kind = ArrayType(StructType([StructField(f, StringType()) for f in fields]))
    of = lambda b, u: evaluate.rows(b, u, list_rule, fields)
    return _exploded(mapped(pages.select(*keep, body, base), body, base, "_r", kind, of), "_r", list(keep))


def book_rows(pages: DataFrame, rules: Mapping[str, str], detail_pattern: str = "", body: str = "html", base: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    kind = ArrayType(StructType([StructField(f, StringType()) for f in evaluate.BOOK]))
    of = lambda b, u: evaluate.books(b, u, rules, detail_pattern)
    return _exploded(mapped(pages.select(*keep, body, base), body, base, "_r", kind, of), "_r", list(keep))


def info_rows(pages: DataFrame, rules: Mapping[str, str], body: str = "html", base: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    fields = (*evaluate.BOOK, "tocUrl")
    kind = StructType([StructField(f, StringType()) for f in fields])
    of = lambda b, u: evaluate.book_info(b, u, rules)
    return mapped(pages.select(*keep, body, base), body, base, "_r", kind, of).select(*keep, "_r.*")


def text_values(pages: DataFrame, rule: str, out: str = "value", body: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A document rule's values, one row each, in order."""
    of = lambda b, u: extract.texts(parse(b), rule)
    df = mapped(pages.select(*keep, body), body, None, "_r", ArrayType(StringType()), of)
    return df.select(*keep, F.posexplode("_r").alias("seq", out))


def content_rows(pages: DataFrame, rules: Mapping[str, str], body: str = "html", base: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Each page's content and the URL of its next page."""
    kind = StructType([StructField("content", StringType()), StructField("next_url", StringType())])
    of = lambda b, u: dict(zip(("content", "next_url"), evaluate.content(b, u, rules)))
    return mapped(pages.select(*keep, body, base), body, base, "_r", kind, of).select(*keep, "_r.*")
