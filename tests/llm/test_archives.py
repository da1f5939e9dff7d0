"""Tar shards and WARC files, written and read back."""

import collections
import hashlib
import io
import tarfile
import zlib

import duckdb
from pyarrow import fs

from folioq.llm import media as M, warc as W
from folioq.llm.common import store_of


def test_image_round_trip():
    for text in ("", "x", "é" * 96, "long " * 5000):
        p = M.payload_of(text)
        assert len(p) % 192 == 0 and len(p) > 0 and p.rstrip(b" ") == text.encode().rstrip(b" ")
        image = M.image_of(p)
        assert M.samples_of(image) == p and M.header_of(image[:33]) == (192, len(p) // 192, 8)


def test_media_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = M.op6_media_columns(spark, sf).collect()
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        raw, p = docs[r["doc_id"]].encode(), M.payload_of(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) and r["height"] * r["width"] == len(p)
        assert by_text.setdefault(raw, (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])


def test_media_edges(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (2, "", "z"), (3, "é" * 96, "q")], "doc_id bigint, text string, shard string").coalesce(1)
    index = M.store(df, shard_bytes=1024)
    rows = M.with_features(M.with_headers(index)).orderBy("doc_id").collect()
    assert [r["n_bytes"] for r in rows] == [0, 0, 0, 192] and len({r["media_sha256"] for r in rows[:3]}) == 1 and rows[0]["kind"] == "png"
    assert M.store(df.limit(0)).collect() == []
    folder, _, name = rows[3]["shard"].rpartition("/")
    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/{name}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
        member = next(m for m in t.getmembers() if m.name == f"{rows[3]['payload_sha256']}.png")
        assert (member.offset_data, member.size) == (rows[3]["offset"], rows[3]["length"]) and hashlib.sha256(t.extractfile(member).read()).hexdigest() == rows[3]["media_sha256"]


def test_warc_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(tuple(r) for r in W.op8_warc_records(spark, sf).collect()) == sorted(con.execute(W.SQL8).fetchall())


def test_warc_edges(spark, tmp_path):
    big = "x" * 200
    rows = [(k, f"http://u/{k % 3}", big if k % 2 else f"y{k}" * 60) for k in range(200)] + [(5, "http://u/2", big), (None, "u", big), (None, None, None), (7, "s", "short"), (8, "s", "short"), (9, None, "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    m = W.write(df, str(tmp_path / "a"), roll_bytes=2000)
    got = W.read(m, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    kinds = collections.Counter((r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {("response", None): 105, ("revisit", 1): 101} and all(r["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and r["payload_bytes"] == 200 for r in got if r["record_type"] == "revisit")
    files = {r["name"]: r["sha256"] for r in m.collect()}
    again = W.write(df.repartition(7), str(tmp_path / "b"), roll_bytes=2000)
    assert {r["name"]: r["sha256"] for r in again.collect()} == files and len(files) > 4
    left = [f.base_name for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(str(tmp_path / "a")))]
    assert sorted(left) == sorted(files)
    assert W.read(W.write(df.limit(0), str(tmp_path / "c")), str(tmp_path / "c")).collect() == []


def test_warc_null_heads(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", "z" * 150), (None, "b", "z" * 150)], "page_id bigint, url string, html string")
    got = W.read(W.write(df, str(tmp_path / "n")), str(tmp_path / "n")).collect()
    assert collections.Counter((r["record_type"], r["refers_to"]) for r in got) == {("response", None): 1, ("revisit", None): 1}


def test_odd_urls(spark, tmp_path):
    urls = ["http://u/a\r\n\r\nb", "http://u/\r\nWARC-Type: revisit", " http://u/ ", "http://u/\t%0D\x00", "é: x", ""]
    df = spark.createDataFrame([(k, u, f"page {k} " * 20) for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    m = W.write(df, str(tmp_path / "o"))
    got = {r["page_id"]: (r["url"], r["record_type"]) for r in W.read(m, str(tmp_path / "o")).collect()}
    assert got == {k: (u, "response") for k, u in enumerate(urls)}
    store, root = store_of(str(tmp_path / "o"))
    for r in m.collect():
        with store.open_input_stream(f"{root}/{r['name']}", compression=None) as f:
            heads = [W.parsed(b)[0]["warc-type"] for b in W.members(f)]
        assert heads[0] == "warcinfo" and heads.count("warcinfo") == 1 and len(heads) == r["n_records"] + 1
