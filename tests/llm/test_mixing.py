"""Weighted fair queueing."""

import collections

import duckdb
import pytest

from folioq.llm import mixing as M

SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
      2.0 * source_size / weight AS stop FROM w WINDOW b AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, stop) AS level FROM l WHERE level <= stop)
SELECT source, source_size, least(2.0 * source_size, coalesce((SELECT level FROM v), 'inf'::DOUBLE) * weight) AS target FROM l"""


def reshared(sizes):
    """Targets by giving each what its weight says, and resharing what is above twice a source's size, until nothing is."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = budget - sum(fixed.values())
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > 2 * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: 2.0 * sizes[s] for s in over}


def plain(docs, target):
    """The mix in one list: every source's quanta with their virtual finish, sorted, cut at the budget. Needs Spark's hash for the order."""
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(d, r["text"]) for d, r in docs.items()], "doc_id bigint, text string")
    keys = {r["doc_id"]: r["order_key"] for r in M.sized(df, "text", ["doc_id"]).collect()}
    quanta, sizes = [], {d: len((r["text"] or "").encode().split()) for d, r in docs.items()}
    for s in target:
        own = sorted((d for d in docs if docs[d]["source"] == s), key=lambda d: (keys[d] % (1 << 64), sizes[d]))
        at = 0
        for epoch in range(2):
            for d in own:
                for q in range(0, sizes[d], M.QUANTUM):
                    words = min(M.QUANTUM, sizes[d] - q)
                    at += words
                    quanta.append((at / target[s], s is None, s or "", keys[d], epoch, d, words))
    left, taken = int(1.5 * sum(sizes.values())), collections.Counter({d: 0 for d in docs})
    for *_, d, words in sorted(quanta):
        taken[d] += min(words, left)
        left -= min(words, left)
    return taken


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows, again = (sorted(map(tuple, M.op5_source_mix(spark, sf).drop("virtual_finish", "turns").collect())) for _ in range(2))
    assert rows == again
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, sizes, target = collections.Counter(), collections.Counter(), {}
    for d, size, source_size, goal, got in rows:
        assert size == len(docs[d]["text"].encode().split()) and got <= 2 * size
        s = docs[d]["source"]
        taken[s] += got
        sizes[s] += size
        target[s] = goal
    want = reshared(sizes)
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= M.QUANTUM for s in sizes)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert {d: got for d, _, _, _, got in rows} == plain(docs, want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert all(target[s] == pytest.approx(t) and sizes[s] == n for s, n, t in con.execute(SQL).fetchall())


def test_edges(spark):
    rows = [(1, "a", "one two"), (1, "a", "one two"), (2, None, "x y z"), (3, "b", None), (4, "b", ""), (None, "c", "w " * 300), (5, "c", "v")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id int, source string, text string, size int")
    got = M.mix(M.written(M.sized(df, "text", ["doc_id"]), "t")).collect()
    assert len(got) == len(rows) and "size" in got[0].asDict() and sum(r["taken"] for r in got) == int(1.5 * 308)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    want = reshared({"a": 4, None: 3, "b": 0, "c": 301})
    assert all(abs(taken[s] - want[s]) <= M.QUANTUM for s in want)
    assert M.mixed(df).columns == df.columns and M.mixed(df.limit(0)).collect() == [] and M.mix(M.written(M.sized(df.limit(0)), "t")).collect() == []
    assert M.mixed(df.where("source = 'b'")).collect() == []


def test_order_is_by_virtual_finish(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], "w " * (k % 7 + 1)) for k in range(200)], "doc_id int, source string, text string")
    mix = M.mixed(df).collect()
    a = [r["source"] for r in mix[:60]].count("a")
    assert 25 <= a <= 45 and len(mix) > 200  # sources of like targets take turns from the first document on


def test_mix_of_documents_keeps_the_budget(spark):
    df = spark.createDataFrame([(k, "abcd"[k * k % 4], f"w{k} " * (k % 90 + 1)) for k in range(3000)], "doc_id int, source string, text string")
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert words(M.mixed(df).collect()) == pytest.approx(1.5 * words(df.collect()), rel=0.01)


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04d}": (k * 7919) % 1000 for k in range(500)} | {None: 50}
    rows = [(s is None, s or "", n) for s, n in sizes.items()]
    got = {(None if r["nul"] else r["src"]): r["target"] for r in M.targets(spark.createDataFrame(rows, "nul boolean, src string, source_size bigint").repartition(5)).collect()}
    want = reshared(sizes)
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in sizes)


def test_the_copy_of_the_texts_is_small(spark):
    import glob
    import os

    import numpy as np

    from folioq.llm.common import shared_dir, written

    def kept(name):
        newest = max(glob.glob(f"{shared_dir(spark)}/folioq/{name}-*"), key=os.path.getmtime)
        return sum(os.path.getsize(f) for f in glob.glob(f"{newest}/*.parquet"))

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, "ab"[k % 2], " ".join(f"word{x}" for x in rng.integers(0, 2_000, 300))) for k in range(2_000)], "doc_id int, source string, text string")
    written(df, "plain-rows")
    assert M.mixed(df).count() > 2_000
    assert kept("mix-rows") < 0.75 * kept("plain-rows")
