"""A deterministic, sharded WARC writer.

Records are range-sorted by payload digest and page id, so copies of a payload stand together and the first of them is
the smallest id. The order is cut at keys that a hash picks from all rows (a group of copies may be cut), and for the few
digests that a cut divides, the smallest id is looked up. Each part is written in order into files that roll by their
compressed size; every record is a gzip member of its own, with headers and digests made anew from the payload. A task
writes under temporary names; what it has written goes into a manifest table, whose rows Spark commits once. Files in
the manifest then get their final names, which depend on the records alone, and a reader takes the manifest's files only,
so leftovers of lost tasks are never read.

Every file begins with a warcinfo record. Control characters and outer blanks of a URL, which a header can't hold, are
percent-encoded in the target, and the URL itself is kept in base64 beside it; reading gives it back.

A null page is an empty payload. A null URL is written as an empty target. A null page_id gets a record like any other;
it is last among equal payloads, and if no other has an id, the copies refer to null. Repeated rows get a record each:
of equal ids, one is the response and the others revisit it. An empty table makes an empty manifest and no files. The
input's other columns are not archived.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioq.llm.common import dropped, fresh_path, partitions, store_of, table, written

#: A part holds about PART_BYTES of payloads, so that there are more parts, not larger ones, for more pages.
ROLL_BYTES, PART_BYTES, LEVEL, LEAST = 32 << 20, 48 << 20, 3, 100
ODD = re.compile(r"[\x00-\x1f\x7f]|^ | $")
DATE = "2024-01-01T00:00:00Z"  # a run's date is its caller's to give: archives of equal rows are equal
MANIFEST = "part int, file int, temporary string, name string, n_records bigint, n_bytes bigint, sha256 string"
KEY = ("digest", "nul", "num", "link")


def record_id(digest: str, page_id: int | None, link: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page_id}/{copy}/{link}')}>"


def _fields(version: str, pairs: list[tuple[str, str]]) -> bytes:
    return (version + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def _sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def info(name: str, date: str) -> bytes:
    """The record that a file begins with."""
    block = b"format: WARC File Format 1.1\r\nsoftware: folioq\r\n"
    pairs = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", None, name, 0)), ("WARC-Date", date), ("WARC-Filename", name), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return _fields("WARC/1.1", pairs) + block + b"\r\n\r\n"


def record(kind: str, url: str, page_id: int | None, payload: bytes, digest: str, identity: str, refers: tuple[str, int | None] | None, date: str) -> bytes:
    """One record. A revisit's block holds the HTTP head alone, its headers the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    target = ODD.sub(lambda m: f"%{ord(m[0]):02X}", url)
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if target != url:
        pairs.append(("X-Page-URL", base64.b64encode(url.encode()).decode()))
    if page_id is not None:
        pairs.append(("X-Page-ID", str(page_id)))
    if refers:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[0])]
        if refers[1] is not None:
            pairs.append(("X-Refers-To-Page", str(refers[1])))
    return _fields("WARC/1.1", [*pairs, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


class _Roll:
    """Files of one part, written in order under temporary names."""

    def __init__(self, folder: str, part: int, limit: int, date: str):
        self.fs, self.root = store_of(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.limit, self.date, self.attempt = part, limit, date, uuid.uuid4().hex
        self.done: list[tuple] = []
        self.out = None

    def add(self, body: bytes) -> None:
        if self.out is None:
            self.temporary = f".{self.part:06d}-{len(self.done):05d}.{self.attempt}.part"
            self.name = f"{self.part:06d}-{len(self.done):05d}.warc.gz"
            self.out, self.n, self.size, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temporary}"), 0, 0, hashlib.sha256()
            self.put(info(self.name, self.date))
        self.put(body)
        self.n += 1
        if self.size >= self.limit:
            self.roll()

    def put(self, body: bytes) -> None:
        member = gzip.compress(body, LEVEL, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def roll(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.part, len(self.done), self.temporary, self.name, self.n, self.size, self.sha.hexdigest()))
            self.out = None


def write(df: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE, least: int = LEAST) -> DataFrame:
    """Archives df (page_id, url, html) in folder and returns the manifest. Payloads of `least` bytes or more are kept once."""
    rows = df.select("page_id", F.coalesce("url", F.lit("")).alias("link"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select(F.sha2("html", 256).alias("digest"), F.col("page_id").isNull().alias("nul"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("num"), "link", F.octet_length("html").alias("size"), "html")
    light = written(rows.select("digest", "nul", "num", "link", "size"), "warc-keys")
    total = light.agg(F.sum("size")).first()[0] or 0
    n = max(2, partitions(df.sparkSession), -(-total // PART_BYTES))
    pick = F.xxhash64("num", "link")
    picks = sorted(tuple(r["k"]) for r in light.groupBy(F.pmod(pick, F.lit(8 * n))).agg(F.min_by(F.struct(*KEY), pick).alias("k")).collect())
    cuts = picks[8::8]  # n at most
    cut_digests = sorted({c[0] for c in cuts})
    heads = light.where(F.col("digest").isin(cut_digests)) if cut_digests else light.limit(0)
    heads = {r["digest"]: tuple(r["k"]) for r in heads.groupBy("digest").agg(F.min(F.struct("nul", "num", "link")).alias("k")).collect()}
    dropped(light)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(len(KEY))))
            parts = pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*KEY, "size", "html", "part"])

    def wrote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, last, head, copy, same = None, None, None, 0, None
        manifest: list[tuple] = []
        for batch in batches:
            for digest, nul, num, link, size, html, part in zip(*(c.to_pylist() for c in batch.columns)):
                if roll is None or roll.part != part:
                    if roll:
                        roll.roll()
                        manifest += roll.done
                    roll, last, same = _Roll(folder, part, roll_bytes, date), None, None
                page_id, key = None if nul else num, (digest, nul, num, link)
                copy, same = (copy + 1, same) if key == same else (0, key)  # equal keys are never cut apart
                identity = record_id(digest, page_id, link, copy)
                first = digest != last
                if first:
                    # a part may begin within a group of copies: the group's head then stands in an earlier part
                    before = heads.get(digest, key[1:])
                    first = before == key[1:]
                    of = None if before[0] else before[1]
                    head, last = (record_id(digest, of, before[2], 0), of), digest
                payload = html.encode()
                kind = "response" if first or size < least else "revisit"
                roll.add(record(kind, link, page_id, payload, digest, identity, head if kind == "revisit" else None, date))
        if roll:
            roll.roll()
            manifest += roll.done
        if manifest:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*manifest), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["part", "file", "temporary", "name", "n_records", "n_bytes", "sha256"])

    parts = rows.mapInArrow(placed, StructType([*rows.schema.fields, StructField("part", IntegerType())])).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", *KEY)
    manifest = written(parts.mapInArrow(wrote, MANIFEST), "warc-manifest")

    def committed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{root}/{r['temporary']}").type != pa.fs.FileType.NotFound:  # else an earlier attempt has done it
                    fs.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
            yield batch

    return written(manifest.mapInArrow(committed, MANIFEST), "warc-committed")


def members(stream) -> Iterator[bytes]:
    """The gzip members of an open file, one by one."""
    inflate, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        out.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            yield b"".join(out)
            inflate, out, data = zlib.decompressobj(31), [], inflate.unused_data


def parsed(body: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and block."""
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the manifest's files; digests are held against the blocks and payloads."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for body in members(f):
                        h, block = parsed(body)
                        if h["warc-type"] == "warcinfo":
                            continue
                        payload, digest, size = block.partition(b"\r\n\r\n")[2], h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != h["warc-block-digest"]:
                            raise ValueError(f"{name}: a block's digest is wrong")
                        if h["warc-type"] == "response":
                            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                            if "sha256:" + digest != h["warc-payload-digest"]:
                                raise ValueError(f"{name}: a payload's digest is wrong")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        url = base64.b64decode(h["x-page-url"]).decode() if "x-page-url" in h else h["warc-target-uri"]
                        rows.append((number("x-page-id"), url, h["warc-type"], size, digest, number("x-refers-to-page"), h["warc-record-id"]))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    return manifest.select("name").repartition(max(2, manifest.count())).mapInArrow(opened, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, record_id string")


def op8_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), folder)
    return read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL8 = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = head THEN NULL ELSE head END AS refers_to, url FROM m
"""
