"""Requests to responses. The default looks stored pages up; HTTP is for the caller to ask for."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from urllib.error import HTTPError, URLError
from urllib.request import Request as HttpRequest, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from folioq.operators.batches import sliced
from folioq.rules.evaluate import Script
from folioq.rules.urlrule import compile_url
from folioq.sources.charset import decoded

RESPONSE = "url string, status int, body string, contentType string, attempts int"
REQUEST = "url string, method string, headers array<struct<k:string,v:string>>, body string, retry int, responseType string, charset string, proxy string, serverId bigint, webView boolean, webJs string, webViewDelayTime bigint"
PAUSE_S, TIMEOUT_S = 0.2, 15


def requests(rows: DataFrame, rule: str, key: str = "key", page: str = "page", base: str = "", headers: str | None = None, scripts: Mapping[str, Script] | None = None) -> DataFrame:
    """rows with `request`: the rule compiled for each row's keyword and page."""
    names = [*rows.columns, "request"]
    at = rows.columns.index(key), rows.columns.index(page)
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, _parse_datatype_string

    kind = _parse_datatype_string(REQUEST)
    arrow = to_arrow_type(kind)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for k, p in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist()):
                r = compile_url(rule, k or "", p or 1, base, headers, scripts)
                out.append({"url": r.url, "method": r.method, "headers": [{"k": a, "v": b} for a, b in r.headers], "body": r.body, "retry": r.retry, "responseType": r.as_hex, "charset": r.charset, "proxy": r.proxy, "serverId": r.server, "webView": r.rendering.wanted, "webJs": r.rendering.script, "webViewDelayTime": r.rendering.wait_ms})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=names)

    return rows.mapInArrow(made, StructType([*rows.schema.fields, StructField("request", kind)]))


def stored(requests_: DataFrame, pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Responses from a table of pages; a URL that isn't there is a 404."""
    found = pages.groupBy(F.col(url).alias("url")).agg(F.min(body).alias("body"))
    rows = requests_.select("request.url").join(found, "url", "left")
    return rows.select("url", F.when(F.col("body").isNotNull(), 200).otherwise(404).alias("status"), "body", F.lit("text/html").alias("contentType"), F.lit(1).alias("attempts"))


Send = Callable[[str, str, dict[str, str], bytes | None], tuple[int, bytes, str, str]]


def http(url: str, method: str, headers: dict[str, str], body: bytes | None) -> tuple[int, bytes, str, str]:
    """One attempt: status, bytes, content type, final URL."""
    try:
        with urlopen(HttpRequest(url, body, headers, method=method), timeout=TIMEOUT_S) as r:
            return r.status, r.read(), r.headers.get("Content-Type", ""), r.url
    except HTTPError as e:
        return e.code, e.read(), e.headers.get("Content-Type", ""), url


def fetched(request: Mapping, send: Send = http, pause: float = PAUSE_S) -> dict:
    """A response after retries: on transport errors and statuses of 500 and more, waiting longer each time."""
    headers, body = {h["k"]: h["v"] for h in request["headers"] or []}, request.get("body")
    status, raw, kind, final, attempt = 0, b"", "", request["url"], 0
    for attempt in range(1, (2 if request.get("retry") is None else request["retry"]) + 2):
        try:
            status, raw, kind, final = send(request["url"], request.get("method") or "GET", headers, body.encode() if body else None)
            if status < 500:
                break
        except (URLError, OSError):
            status = 0
        time.sleep(pause * attempt)
    text = raw.hex() if request.get("responseType") else decoded(raw, request.get("charset"), kind)
    return {"url": final, "status": status, "body": text, "contentType": kind, "attempts": attempt}


def fetch(requests_: DataFrame, send: Send = http, pause: float = PAUSE_S) -> DataFrame:
    """Responses over the network, from the executors."""
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [fetched(r, send, pause) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], k) for n, k in zip(names, kinds)], names=names)

    return requests_.select("request").mapInArrow(sent, RESPONSE)


class UrlSource(DataSource):
    """spark.read.format("folioq-urls").option("urls", lines).load(): one partition per so many URLs."""

    @classmethod
    def name(cls) -> str:
        return "folioq-urls"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _UrlReader(self.options)


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _UrlReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.size = int(options.get("perPartition", "50"))

    def partitions(self) -> list[_Part]:
        return [_Part(self.urls[k : k + self.size]) for k in range(0, len(self.urls), self.size)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for url in partition.urls:
            r = fetched({"url": url, "headers": []})
            yield r["url"], r["status"], r["body"], r["contentType"], r["attempts"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UrlSource)
