"""Fingerprints, the index and the components against brute force."""

import collections

import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioq.llm import simhash as S


def slow(text, shingle=3):
    words = text.encode().lower().split()
    parts = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] if len(words) >= shingle else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, ids):
    u, inv = np.unique(np.array(fps, dtype=np.uint64), return_inverse=True)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2, 1))
    root, least = S.forest(len(u), iter([(i, j)]))[inv], {}
    for r, d in zip(root, ids):
        least[r] = min(least.get(r, d), d)
    return [least[r] for r in root]


def test_fingerprint():
    for t in ("", " ", "One", "one two", "a b c", "A\tb\nc d é", "x " * 70_000):
        assert S.fingerprint(t.encode()) & S.MASK64 == slow(t)


def test_tables_cover_two_bits():
    masks = [S._key_mask(k) for k in range(9)]
    for a in range(64):
        for b in range(a, 64):
            assert any(not m & ((1 << a) | (1 << b)) for m in masks)
    for fields in S.tables():
        assert sorted(x for s, w in fields for x in range(s, s + w)) == list(range(64))


def test_gray_rank():
    n = np.arange(1024, dtype=np.uint64)
    assert (S.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_index():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 6, 80, dtype=np.uint64)) for b in base]))
    fps = fps[np.argsort(S.gray_rank(fps))]
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert (S.forest(len(fps), S.GrayIndex(fps).links(2)) == S.forest(len(fps), iter([(i, j)]))).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    fps = []
    for b in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(40):
            x = int(b)
            for _ in range(rng.integers(0, 5)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.append(x)
    fps += [0, 3, 12, 1 << 63, (1 << 63) | 1]
    rows = [(S.signed(x), k) for k, x in enumerate(fps)]
    got = {r["fp"]: r["component"] for r in S.components(spark.createDataFrame(rows, "fp bigint, k int"), F.col("k")).collect()}
    assert [got[S.signed(x)] for x in fps] == groups(fps, list(range(len(fps))))


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op7_simhash_groups(spark, sf).collect()}
    fps = [S.fingerprint(r["text"].encode()) & S.MASK64 for r in docs]
    assert len(got) == len(docs) and [got[r["doc_id"]] for r in docs] == [(f"{f:016x}", c) for f, c in zip(fps, groups(fps, [r["doc_id"] for r in docs]))]


def test_similar_texts_are_found(spark):
    rng = np.random.default_rng(4)
    rows, copies = [], 0
    for k in range(60):
        words = [f"w{x}" if x > 6_000 else f"f{x % 40}" for x in rng.integers(0, 20_000, int(rng.integers(60, 700)))]
        rows.append((10 * k, " ".join(words), "s"))
        for c in range(3):
            edited = words[:]
            for at in range(int(rng.integers(0, 50)), len(words), 60):
                edited[at] = f"x{k}{c}{at}"
            rows.append((10 * k + c + 1, " ".join(edited), "s"))
            copies += 1
    kept = {r["doc_id"] for r in S.deduplicated(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert {10 * k for k in range(60)} <= kept and len(kept) - 60 <= 0.1 * copies


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in range(400)]
    rows = [(0, " ".join(words), "s")]
    for k in range(1, 1500):
        edited = words[:]
        for at in rng.integers(0, 400, 4):
            edited[at] = f"x{k}{at}"
        rows.append((k, " ".join(edited), "s"))
    kept = S.deduplicated(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    assert 0 in {r["doc_id"] for r in kept} and len(kept) < 30


def test_appended_and_cut_passages(spark):
    rng = np.random.default_rng(6)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3_000, int(rng.integers(60, 900)))]
        part = int(len(words) * rng.uniform(0.05, 0.3))
        common = [f"p{x}" for x in range(part)] if k % 3 else [f"q{k}{x}" for x in range(part)]
        texts += [words, words + common, words[: len(words) - part], words[: len(words) // 2] + common + words[len(words) // 2 :]]
    sets = [set(zip(*(w[k:] for k in range(5)))) for w in texts]
    pairs = [(a, b) for a, x in enumerate(sets) for b in range(a + 1, len(sets)) if len(x & sets[b]) >= 0.8 * len(x | sets[b])]
    assert len(pairs) > 60
    root = S.forest(len(texts), iter([(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))]))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id int, text string").repartition(3)
    assert {r["doc_id"] for r in S.deduplicated(df).collect()} == set(root.tolist())


def test_edges(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "x"), (2, "a b c d", "x"), (None, None, "x"), (7, "", "x"), (None, "q w e r t y", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, fingerprint string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect())
    assert got == {(1, 1): 1, (2, 1): 2, (None, 7): 1, (7, 7): 1, (None, None): 1}
    kept = S.deduplicated(df).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 1, 7] and S.deduplicated(df).columns == df.columns
    assert S.near_duplicates(df.limit(0)).collect() == [] and S.deduplicated(df.limit(0)).collect() == []


def test_packed_rows_come_back(spark):
    from folioq.llm.common import packed, unpacked

    rows = [(k % 7 if k % 5 else None, k, f"t{k}" if k % 3 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, k int, t string").repartition(3)
    assert sorted(unpacked(packed(df, "g")).select("g", "k", "t").collect(), key=lambda r: r["k"]) == rows
    assert packed(df, "g").count() <= 3 * 8 and packed(df.limit(0), "g").collect() == []


def test_shingles_of_one_text_go_out_small(spark):
    """All shingles are sent to be counted; those of one text only, most of them, must not cost a row each."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 100_000, 1_000))) for k in range(400)]
    texts = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    sizes = spark.createDataFrame([(k, len(S.shingles(t.encode()))) for k, t in rows], "id bigint, size bigint")
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    whole = S.written(texts, "test-texts")  # its own shuffle isn't counted
    before = sent()
    assert S._postings(whole, sizes, 0.8).isEmpty()
    assert 0 < sent() - before < 8 * 400 * 996


def test_dealt_shingles_come_back():
    rng = np.random.default_rng(9)
    tokens, ids = rng.integers(0, 1 << 64, 5_000, dtype=np.uint64), rng.integers(0, 1 << 62, 5_000)
    tokens[::7] = tokens[0]
    tokens[5], tokens[6] = 0, S.MASK64
    rows = [r for b in S._dealt(tokens, ids, 4) for r in b.to_pylist()]
    batch = S.pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["bucket"]))
    got = [np.concatenate(x) for x in zip(*S._buckets(iter([batch.slice(0, 5), batch.slice(5)])))]
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip((tokens >> np.uint64(28)).tolist(), ids.tolist()))
