"""Media columns: payloads in tar shards, found by their content.

A payload is stored once per shard as a greyscale image (PNG: 8-bit samples, 192 to a row, lossless) in a member named
by the payload's SHA-256. Tables carry the digest, the shard, the offset and the length; no payload. What a column wants
to know of the medium (its width, height and depth) comes from a range read of the image's first 33 bytes; whoever needs
the samples reads that one range.

Shards are written by the tasks that read the texts, so no payload is shuffled: each into the folder that all executors
share, under a name of its attempt, closed and renamed before its rows are given out. If a task is lost, the next
attempt writes shards of other names; rows name the shards they were written with, and `written` fixes them once.

A null text is an empty one; its payload is 192 spaces. Copies have equal digests and equal images; within a shard they
share one member. Repeated rows get a row each. Columns of the input that have an output's name give way to it.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioq.llm.common import fresh_path, store_of, table, without, written

WIDTH, SHARD_BYTES, LEVEL = 192, 64 << 20, 1
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33
STORED = {"payload_sha256": "string", "shard": "string", "offset": "bigint", "length": "bigint", "n_bytes": "bigint"}
HEAD = {"width": "bigint", "height": "bigint", "bit_depth": "bigint", "kind": "string"}


def payload_of(text: str) -> bytes:
    """UTF-8 with spaces appended up to a positive multiple of WIDTH."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def image_of(payload: bytes) -> bytes:
    """A PNG whose samples are the payload's bytes. Rows are unfiltered: each begins with a zero."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), LEVEL)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", head[16:25])


def samples_of(image: bytes) -> bytes:
    """The payload, from an image as image_of makes them."""
    width, height, _ = header_of(image[:HEADER])
    at, body = HEADER, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        part = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            body.append(part)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Of the samples: an average hash over an 8 x 8 grid (16 hex digits), mean and deviation in thousandths."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    n = len(x)
    bands = np.add.reduceat(x, np.minimum(np.arange(8) * n // 8, n - 1), axis=0, dtype=np.int64)
    grid = bands.reshape(8, 8, WIDTH // 8).sum(axis=2)
    count = np.maximum(np.diff([*(np.arange(8) * n // 8), n]), 1)[:, None] * (WIDTH // 8)
    total = int(x.sum(dtype=np.int64))
    means = grid * n * WIDTH > total * count
    bits = int.from_bytes(np.packbits(means).tobytes(), "big")
    mean = total / x.size
    squares = int(np.square(x, dtype=np.uint16).sum(dtype=np.int64))
    deviation = max(0.0, squares / x.size - mean * mean) ** 0.5
    return f"{bits:016x}-{round(mean * 1000):06d}-{round(deviation * 1000):06d}"


class Shard:
    """An open tar file in the store; renamed when it's closed."""

    def __init__(self, folder: str):
        self.fs, root = store_of(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.temporary, self.final = f"{root}/.{self.name}.part", f"{root}/{self.name}"
        self.out, self.size, self.members = self.fs.open_output_stream(self.temporary), 0, {}

    def add(self, digest: str, data) -> tuple[int, int]:
        """Offset and length of the member with this name, written now if it's new. data() gives its bytes."""
        if digest not in self.members:
            body = data()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(body)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + body + b"\0" * (-len(body) % tarfile.BLOCKSIZE))
            self.members[digest] = (self.size + len(head), len(body))
            self.size += len(head) + len(body) + -len(body) % tarfile.BLOCKSIZE
        return self.members[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
        self.out.close()
        self.fs.move(self.temporary, self.final)


def store(df: DataFrame, text: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """df without the text, with the columns STORED. Written once, so each row names the shard that holds its payload."""
    folder = folder or fresh_path(df.sparkSession, "media")
    rest = without(df.drop(text), *STORED).columns
    names = [*rest, *STORED]
    schema = StructType([*(df.schema[c] for c in rest), *(StructField(n, StringType() if k == "string" else LongType()) for n, k in STORED.items())])
    kinds = [pa.string() if k == "string" else pa.int64() for k in STORED.values()]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []

        def given() -> Iterator[pa.RecordBatch]:
            for columns, rows in waiting:
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)
            waiting.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                shard = shard or Shard(folder)
                for t in part.column(len(rest)).to_pylist():
                    payload = payload_of(t or "")
                    digest = hashlib.sha256(payload).hexdigest()
                    offset, length = shard.add(digest, lambda: image_of(payload))  # noqa: B023  called at once
                    rows.append((digest, shard.name, offset, length, len((t or "").encode())))
                waiting.append((part.columns[: len(rest)], rows))
                if shard.size >= shard_bytes:
                    shard.close()
                    shard = None
                    yield from given()
        if shard:
            shard.close()
        yield from given()

    found = df.select(*[f"`{c}`" for c in rest], f"`{text}`").mapInArrow(stored, schema)
    return written(found, "media-index").withColumn("shard", F.concat(F.lit(folder.rstrip("/") + "/"), "shard"))


class Reader:
    """Ranges of shards; the last shard stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def range(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.path:
            folder, _, name = shard.rpartition("/")
            fs, root = store_of(folder)
            self.path, self.file = shard, fs.open_input_file(f"{root}/{name}")
        return self.file.read_at(length, offset)


def _mapped(df: DataFrame, added: dict[str, str], of) -> DataFrame:
    """df with the columns `added`, made by of(reader, row of STORED) for every place; a place is read once in a batch."""
    df = without(df, *added)
    names = [*df.columns, *added]
    schema = StructType([*df.schema.fields, *(StructField(n, StringType() if k == "string" else LongType()) for n, k in added.items())])
    kinds = [pa.string() if k == "string" else pa.int64() for k in added.values()]
    at = [df.columns.index(c) for c in ("shard", "offset", "length", "payload_sha256")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            known: dict[tuple, tuple] = {}
            rows = list(zip(*(batch.column(k).to_pylist() for k in at)))
            for r in rows:
                if r not in known:
                    known[r] = of(reader, *r)
            new = zip(*(known[r] for r in rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(new, kinds))], names=names)

    return df.mapInArrow(made, schema)


def by_shard(index: DataFrame) -> DataFrame:
    """The index dealt by shard, in the order of the payloads: tasks follow the payloads' bytes, not the index's."""
    return index.repartition(max(2, 2 * index.select("shard").distinct().count()), "shard").sortWithinPartitions("shard", "offset")


def with_headers(index: DataFrame) -> DataFrame:
    """The index with HEAD, from range reads of the images' headers alone."""
    return _mapped(index, HEAD, lambda reader, shard, offset, length, digest: (*header_of(reader.range(shard, offset, min(HEADER, length))), "png"))


def _features(reader: Reader, shard: str, offset: int, length: int, digest: str) -> tuple:
    image = reader.range(shard, offset, length)
    payload = samples_of(image)
    read = hashlib.sha256(payload).hexdigest()
    if read != digest:
        raise ValueError(f"{shard} at {offset} doesn't hold {digest}")
    return len(payload), read, zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)


def with_features(index: DataFrame) -> DataFrame:
    """The index with what the samples, read back and held against their digest, give."""
    return _mapped(index, {"payload_bytes": "bigint", "read_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}, _features)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = with_features(with_headers(by_shard(store(table(spark, sf_dir, "documents").select("doc_id", "text")))))
    return media.select("doc_id", "n_bytes", "payload_bytes", F.col("read_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", F.regexp_extract("shard", "[^/]*$", 0).alias("shard"), "offset", "length")
