"""Piece encoding by scan, and counting by splicing, against the library."""

import random

import pytest

from folioq.llm import piece_codec as C, pieces, token_count as N

PATH = pieces.default_model()
SP, S = pieces.model(PATH), pieces.spans(PATH)


def texts():
    rnd = random.Random(1)
    parts = ["a", "b", "th", "the", "ing", " ", "  ", "é", "\n", "中", "😀", "▁", "e", "t", "aaaa", "<s>", "\x00", "<0x0A>", "　"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 900))) for _ in range(25)]
    return [*out, "", " ", "a" * 2000, " " * 2000, "ab" * 700, "thing" * 500, "😀" * 300, "=-" * 500, "▁▁ x"]


@pytest.mark.parametrize("chunk", [16, 37, 1000])
def test_scan_is_the_librarys_encoding(chunk):
    for t in texts():
        assert C.scan_encode(S, t, chunk) == SP.encode(t)


def test_products_are_associative():
    text = "▁" + ("thing▁and▁other▁" * 20)
    ms = [C.transfer(S, text, a, min(a + 40, len(text))) for a in range(0, len(text), 40)]
    left = C.combine(C.combine(ms[0], ms[1]), ms[2])
    assert (left == C.combine(ms[0], C.combine(ms[1], ms[2]))).all()


def test_decoding():
    told = C.decoder(PATH)
    for t in texts():
        assert told(SP.encode(t)) == t.replace("▁", " ")


def test_encode(spark):
    rows = [(k, t, "clash") for k, t in enumerate(texts())] + [(900, None, "x"), (900, None, "x"), (None, "word " * 400, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = C.decode(C.encode(df, giant=200, chunk=64)).collect()
    assert len(got) == len(rows) and max(r["n_chunks"] for r in got) > 10
    for r in got:
        assert r["piece_ids"] == SP.encode(r["text"] or "") and r["n_tokens"] == len(r["piece_ids"]) and r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert C.encode(df.limit(0)).collect() == []


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (300, 16), (1000, 64)])
def test_splicing(chunk, overlap):
    for t in texts():
        assert N.count([t], PATH, 0, chunk, overlap) == [len(SP.encode(t))]


def test_overlaps_widen():
    # no token is shared in the first overlaps: the text has no place where a fresh encoding falls in step at once
    t = "thing" * 2000
    assert N.count([t], PATH, 0, 1000, 2) == [len(SP.encode(t))]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (2, "é" * 5000, "x"), (3, "", "x")], "doc_id bigint, text string, n_bytes string")
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in N.token_counts(df, limit=3000, huge=100, chunk=50, overlap=8).collect())
    assert got == sorted([(1, 3, len(SP.encode("a b")), False)] * 2 + [(0, 0, 0, False), (2, 10000, n := len(SP.encode("é" * 5000)), n > 3000), (3, 0, 0, False)])
    assert N.token_counts(df.limit(0)).collect() == []


def test_whole_table(spark):
    from folioq.llm.common import table

    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: len(SP.encode(r["text"])) for r in table(spark, sf, "documents").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in N.op3_token_counts(spark, sf).collect()} == want
    coded = C.op2_piece_codec(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in coded} == want and all(r["round_trip"] for r in coded)
