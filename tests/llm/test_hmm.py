"""The hidden Markov model against sums over all paths, and its query against plain Python over the table."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from folioq.llm import hmm as H, recursion as R

RNG = np.random.default_rng(0)
K, UNITS = 3, 50
MODEL = R.Model(RNG.dirichlet(np.ones(K)), RNG.dirichlet(np.ones(K), K), RNG.random((UNITS, K)) + 0.01)
RUNS = [RNG.integers(0, UNITS, n).astype(np.int32) for n in (1, 5, 3, 6, 1, 5)]


def paths(run):
    for path in itertools.product(range(K), repeat=len(run)):
        p = MODEL.start[path[0]] * MODEL.emit[run[0], path[0]]
        for i in range(1, len(run)):
            p *= MODEL.move[path[i - 1], path[i]] * MODEL.emit[run[i], path[i]]
        yield path, p


@pytest.mark.parametrize("sizes", [(512, 1024, 400_000), (2, 3, 4)])
def test_whole_documents_however_they_are_cut(monkeypatch, sizes):
    for name, n in zip(("BLOCK", "LONG"), sizes):
        monkeypatch.setattr(R, name, n)
    monkeypatch.setattr(R.Lanes.batches, "__defaults__", (sizes[2],))
    emission, counts, moves, starts = R.Emission(MODEL.emit, np.float64), np.zeros((UNITS, K)), np.zeros((K, K)), np.zeros(K)
    total = R.expected(MODEL, emission, RUNS, counts, moves, starts)
    want, want_moves, want_starts, logs = np.zeros_like(counts), np.zeros_like(moves), np.zeros(K), []
    for r in RUNS:
        every = sum(p for _, p in paths(r))
        logs.append(math.log(every))
        for path, p in paths(r):
            want_starts[path[0]] += p / every
            for i, x in enumerate(r):
                want[x, path[i]] += p / every
                if i:
                    want_moves[path[i - 1], path[i]] += p / every
    assert np.allclose(counts, want) and np.allclose(moves, want_moves) and np.allclose(starts, want_starts) and total == pytest.approx(sum(logs))
    assert np.allclose(R.forward(MODEL, emission, RUNS), logs)


def test_long_documents():
    long = [RNG.integers(0, UNITS, 30_000).astype(np.int32), np.zeros(50_000, np.int32)]
    emission = R.Emission(MODEL.emit, np.float64)
    for x, got in zip(long, R.forward(MODEL, emission, long)):
        a, total = MODEL.start, 0.0
        for k, unit in enumerate(x):
            a = (a @ MODEL.move if k else a) * MODEL.emit[unit]
            total += math.log(a.sum())
            a = a / a.sum()
        assert got == pytest.approx(total, rel=1e-9)
    counts, moves, starts = np.zeros((UNITS, K)), np.zeros((K, K)), np.zeros(K)
    R.expected(MODEL, R.Emission(MODEL.emit), long, counts, moves, starts)
    assert counts.sum() == pytest.approx(80_000, rel=1e-4) and moves.sum() == pytest.approx(79_998, rel=1e-4) and starts.sum() == pytest.approx(2, rel=1e-4)


def check(rows, texts):
    train, n_known = collections.Counter(), 0
    for d, t in texts:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            train.update((t or "").encode().lower().split())
            train["end"] += 1
    n, v = sum(train.values()), len(train)
    for r in rows:
        words = (r["text"] or "").encode().lower().split() + ["end"]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == n and r["n_known"] == sum(w in train for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)) and r["score"] < 0


def test_table(spark):
    from folioq.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = H.op4_hmm_scores(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    for held in (True, False):
        some = [r for r in rows if r["held_out"] == held]
        assert some and sum(r["score"] for r in some) > sum(r["base_score"] for r in some)


def plain(texts, states, first, rounds):
    """Baum-Welch and the forward recursion over words, one document after the other: the model as its docstring tells it."""
    train = [t.encode().lower().split() for d, t in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    n, n_docs, once = sum(c.values()) + len(train), len(train), sum(k == 1 for k in c.values())
    tail = lambda w: ("rare", H.xxhash.xxh64_intdigest(w[-H.TAIL :], 2) % H.ENDINGS)
    unit = lambda w: w if c[w] >= H.OWN else tail(w) if c[w] else "unknown"
    mass = collections.Counter()
    for w, k in c.items():
        mass[unit(w)] += k
    mass["end"] = n_docs
    unknown = (once + 1) / (n + 2)
    start, move, emit = first(c, mass)
    for _ in range(rounds):
        counts, moves, starts = collections.defaultdict(lambda: np.zeros(states)), np.zeros((states, states)), np.zeros(states)
        for t in train:
            e = np.array([emit(u) for u in [*map(unit, t), "end"]])
            a, scale = np.empty_like(e), np.empty(len(e))
            for k in range(len(e)):
                a[k] = (a[k - 1] @ move if k else start) * e[k]
                scale[k] = a[k].sum()
                a[k] /= scale[k]
            b = np.ones(states)
            for k in range(len(e) - 1, -1, -1):
                counts[[*map(unit, t), "end"][k]] += a[k] * b
                if k:
                    moves += move * np.outer(a[k - 1], e[k] * b / scale[k])
                    b = move @ (e[k] * b / scale[k])
                else:
                    starts += a[0] * b
        total = sum(counts.values())
        start, move = (starts + 1) / (starts.sum() + states), (moves + 1) / (moves.sum(axis=1, keepdims=True) + states)
        emit = lambda u, counts=counts, total=total: np.full(states, unknown) if u == "unknown" else (1 - unknown) * (counts[u] + H.PRIOR * mass[u] / n) / (total + H.PRIOR)
    for _, t in texts:
        a, log = None, 0.0
        for w in [*t.encode().lower().split(), "end"]:
            u = w if w == "end" else unit(w)
            a = (start if a is None else a @ move) * emit(u)
            log += math.log10(a.sum() * (c[w] / mass[u] if u[0] == "rare" else 1))
            a = a / a.sum()
        yield log


def test_model_against_plain_python(spark, monkeypatch):
    states, given = 2, {}
    monkeypatch.setattr(H, "TOLERANCE", 0.0)
    monkeypatch.setattr(H, "GROUP", 1)  # several salts

    def initial(held_in, path, size, states):
        emit = np.stack([np.linspace(1, 2, H.CLASSES), np.linspace(2, 1, H.CLASSES)], axis=1) * H._shares(size)[:, None]
        emit[H.UNKNOWN] = H._unknown(size)
        given["emit"] = emit
        return R.Model(np.array([0.4, 0.6]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit)

    monkeypatch.setattr(H, "_initial", initial)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    texts = [(r["doc_id"], r["text"]) for r in rows]

    def first(c, mass):
        emit = given["emit"]

        def of(u):
            if u == "end":
                return emit[H.END]
            if u[0] == "rare":
                return emit[H.OFTEN + u[1]]
            g = H.xxhash.xxh64_intdigest(u, 1) % H.OFTEN
            return emit[g] * c[u] / sum(k for w, k in c.items() if k >= H.OWN and H.xxhash.xxh64_intdigest(w, 1) % H.OFTEN == g)

        known = {u: of(u) for u in mass}
        return np.array([0.4, 0.6]), np.array([[0.7, 0.3], [0.2, 0.8]]), known.__getitem__

    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got, history = H.trained(df, states=states, warm=0, rounds=2)
    found = {r["doc_id"]: r["score"] for r in got.collect()}
    for (d, _), want in zip(texts, plain(texts, states, first, 2)):
        assert found[d] == pytest.approx(want, rel=1e-5)
    assert len(history) == 2


def test_rounds_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    history = H.trained(docs)[1]
    assert all(b > a for a, b in zip(history[H.WARM :], history[H.WARM + 1 :])) and len(history) < H.WARM + H.ROUNDS
    assert history[-1] - history[-2] <= H.TOLERANCE * abs(history[-2])


def test_probabilities_sum_to_one():
    size = {"n": 10, "v": 3, "once": 1, "docs": 2, "mass": np.bincount([5, 5, 7, H.END], minlength=H.CLASSES) * 2.5}
    m = H.maximised(np.zeros((H.CLASSES + K + 1, K)), size, K)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and np.isclose(m.start.sum(), 1)


def test_edges(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, "a b a", "z"), (2, None, "z"), (None, "x", "y"), (None, "x", "y"), (4, "", "y"), (big, "a " * 50, "y")], "doc_id bigint, text string, score string")
    got = H.language_model(df, rounds=1).collect()
    assert len(got) == 6 and all(math.isfinite(r["score"]) for r in got) and big in {r["doc_id"] for r in got}
    assert H.language_model(df.limit(0), rounds=1).collect() == []
    only_held = H.language_model(df.where("doc_id = 1"), rounds=1).collect()
    assert only_held[0]["held_out"] and only_held[0]["train_tokens"] == 0 and math.isfinite(only_held[0]["score"]) and only_held[0]["base_score"] == 0
