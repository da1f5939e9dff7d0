"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Tokens are a text's words (A-Z lower-cased) and one end. A state emits a unit: a word of OWN or more training tokens is
a unit of its own, so the model grows with the vocabulary; rarer words, of which no state could tell much, share one of
4,096 units by their last letters and are emitted within it in proportion to their counts; the end and all unknown words
are units too. Unknown words have the probability that singletons have among training tokens (Good-Turing).

States start from anchors: frequent classes that rarely share documents. WARM rounds with words tied (they share 65,536
classes by their hash, so that a round needs no shuffle) go ahead; then every word's own counts are re-estimated, until a
round gains less than TOLERANCE of the log-likelihood, relative to the round before, or for ROUNDS rounds. Training sees
whole documents (see recursion: no transition is lost at a block's border, and a document's first state counts once).
`trained` also gives the log-likelihood of a training token in each round; it is logged as well.

Texts are read once. Stretches of documents number their words in a dictionary of their own; dictionaries, packed by
cells of the words' hashes, are summed cell by cell, first in groups of stretches (salts), so no task holds all stretches
of a word. What a stretch needs to know of its words comes back as a table partitioned by stretch in the shared folder,
from which tasks read their own stretches. The same way words' expected counts go to the cells and their sums come back.
On the driver there are only class counts (CLASSES rows) and the parameters of moves. A table that has served is removed.

A null text is an empty one: its only token is the end. A null doc_id counts as an empty id when documents are held out.
Repeated rows train and score one by one. Without any training document the base score is 0 and the model splits its
mass between an unknown word and the end. Columns other than the id and the text are ignored. An empty table gives none.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from folioq.llm.common import collected, dropped, fresh_path, small_batches, store_of, table, written
from folioq.llm.recursion import Emission, Model, expected, forward

STATES, WARM, ROUNDS, TOLERANCE = 8, 2, 8, 0.002
OWN, STEP = 10, 4096
OFTEN, ENDINGS, TAIL = 1 << 16, 1 << 12, 3
UNKNOWN, END = OFTEN + ENDINGS, OFTEN + ENDINGS + 1
CLASSES = OFTEN + ENDINGS + 2
SMALL = ENDINGS + 2  # units that aren't words: endings, unknown, end
STRETCH, WORDS, GROUP = 3_000_000, 400_000, 64
ANCHORS, PRIOR = 64, 200.0
FOLDS, HELD = 7, 2
LN10 = math.log(10.0)
TOTALS = ("n", "v", "once", "c log c", "own c log c")  # beyond the classes' counts, in rows behind them

_log = logging.getLogger(__name__)


def pack(x: np.ndarray | bytes) -> bytes:
    raw = x.tobytes() if isinstance(x, np.ndarray) else x
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(x: bytes) -> bytes:
    return pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(unpack(x), kind)


def pack_counts(x: np.ndarray) -> bytes:
    """Expected counts to a 4096th, in fixed point: most of a word's states have none, so equal bytes side by side shrink well."""
    return pack(np.ascontiguousarray(np.rint(x * STEP).astype("<i8").reshape(-1).view(np.uint8).reshape(-1, 8).T))


def counts_of(x: bytes, states: int) -> np.ndarray:
    return np.ascontiguousarray(unpacked(x, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1, states) / STEP


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _cells(df: DataFrame) -> int:
    """How many cells the words are dealt to: more for more partitions, as the vocabulary grows."""
    return 1 << max(4, math.ceil(math.log2(16 * max(1, df.rdd.getNumPartitions()) ** 0.7)))


def _numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of documents (ids: their words' numbers) and of dictionaries by cell (locals, words, n: counts in training)."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    docs = df.select(F.col(key).alias("doc_id"), (fold == HELD).alias("held_out"), F.col(text).cast("binary").alias("text"))
    cells = _cells(docs)
    schema = StructType([StructField("stretch", LongType()), docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("ids", BinaryType()), StructField("cell", IntegerType()), *(StructField(k, BinaryType()) for k in ("locals", "words", "n"))])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 24
        index, counts, tokens, part, kind = _Index(), np.zeros(1024, np.int64), 0, 0, None

        def dictionary() -> Iterator[pa.RecordBatch]:
            names = list(index)
            cell = np.fromiter((xxhash.xxh64_intdigest(w) % cells for w in names), np.int32, len(names))
            order = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0, [True]]))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = order[a:b]
                rows.append((int(cell[here[0]]), pack(here.astype("<i4")), pack(b" ".join([names[k] for k in here])), pack(counts[here].astype("<i8"))))
            m = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([task + part] * m, pa.int64()), pa.nulls(m, kind), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary())))], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                coded, m = [], rows.num_rows
                for t, out in zip(rows.column(2).to_pylist(), rows.column(1).to_pylist()):
                    own = np.array(list(map(index.__getitem__, (t or b"").lower().split())), dtype="<i4")
                    if len(index) > len(counts):
                        counts = np.concatenate([counts, np.zeros(len(index), np.int64)])
                    if not out:
                        np.add.at(counts, own, 1)
                    tokens += len(own)
                    coded.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([task + part] * m, pa.int64()), rows.column(0), rows.column(1), pa.array(coded, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=schema.names)
                if tokens > STRETCH or len(index) > WORDS:
                    yield from dictionary()
                    index, counts, tokens, part = _Index(), np.zeros(1024, np.int64), 0, part + 1
        if index:
            yield from dictionary()

    return docs.mapInArrow(numbered, schema)


def _sorted(df: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows whose first columns agree. A run is a stream: no group is held."""
    for key, run in itertools.groupby(_rows(batches), lambda r: r[:keys]):
        yield key, (r[keys:] for r in run)


def _batch(columns: list[tuple[str, pa.DataType]], *rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def _salted(stretches: int) -> tuple[int, Column]:
    salts = max(1, -(-stretches // GROUP))
    return salts, F.pmod(F.xxhash64("stretch"), F.lit(salts)).cast("int").alias("salt")


def _to_stretches(spark: SparkSession, df: DataFrame, name: str) -> str:
    """df as a table with a folder for each stretch; the folder's path."""
    path = fresh_path(spark, name)
    df.repartition("stretch").write.partitionBy("stretch").parquet(path)
    return path


def _of_stretch(path: str, stretch: int) -> pa.Table:
    fs, root = store_of(path)
    return pq.read_table(f"{root}/stretch={stretch}", filesystem=fs, partitioning=None).sort_by("cell")


def _lexicon(rows: DataFrame, salts: int, salt: Column) -> tuple[str, dict]:
    """For each stretch and cell: locals, c (training counts), g (classes), x (places among their cell's own words, or -1)."""
    spark = rows.sparkSession
    packed = [("cell", pa.int32()), ("words", pa.binary()), ("n", pa.binary())]

    def summed(keys: int):
        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (cell, *_), run in _grouped(batches, keys):
                total: dict[bytes, int] = {}
                for words, n in run:
                    for w, k in zip(unpack(words).split(b" "), unpacked(n, "<i8").tolist()):
                        total[w] = total.get(w, 0) + k
                yield _batch(packed, (cell, pack(b" ".join(total)), pack(np.fromiter(total.values(), "<i8", len(total)))))

        return out

    kinds = "cell int, words binary, n binary"
    parts = _sorted(rows.select("cell", salt, "words", "n"), "cell", "salt").mapInArrow(summed(2), kinds)
    parts = parts if salts == 1 else _sorted(parts, "cell").mapInArrow(summed(1), kinds)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, words, n in _rows(batches):
            some, c = unpack(words).split(b" "), unpacked(n, "<i8")
            own = c >= OWN
            g = np.fromiter((xxhash.xxh64_intdigest(w, 1) % OFTEN if o else OFTEN + xxhash.xxh64_intdigest(w[-TAIL:], 2) % ENDINGS if k else UNKNOWN for w, k, o in zip(some, c.tolist(), own.tolist())), "<i4", len(some))
            x = np.where(own, np.cumsum(own) - 1, -1)
            yield _batch([("cell", pa.int32()), *((k, pa.binary()) for k in ("words", "c", "g", "x"))], (cell, words, pack(c), pack(g), pack(x.astype("<i4"))))

    words = written(parts.mapInArrow(classed, "cell int, words binary, c binary, g binary, x binary"), "hmm-words")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros((CLASSES + len(TOTALS), 1))
        for c, g in _rows(batches):
            c, g = unpacked(c, "<i8").astype(float), unpacked(g, "<i4")
            mass[:CLASSES, 0] += np.bincount(g, c, CLASSES)
            clogc = c * np.log(np.maximum(c, 1))
            mass[CLASSES:, 0] += [c.sum(), (c > 0).sum(), (c == 1).sum(), clogc.sum(), clogc[c >= OWN].sum()]
        yield _told(mass)

    mass = _summed(words.select("c", "g").mapInArrow(told, "g int, c0 double"), CLASSES + len(TOTALS), 1)[:, 0]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, columns = {}, None
        for cell, _, kind, stretch, locals_, some, c, g, x in _rows(batches):
            if not kind:
                place = {w: k for k, w in enumerate(unpack(some).split(b" "))}
                columns = [unpacked(c, "<i8"), unpacked(g, "<i4"), unpacked(x, "<i4")]
            else:
                at = [place[w] for w in unpack(some).split(b" ")]
                yield _batch([("stretch", pa.int64()), ("cell", pa.int32()), *((k, pa.binary()) for k in ("locals", "c", "g", "x"))], (stretch, cell, locals_, *(pack(y[at]) for y in columns)))

    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    known = words.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("stretch"), *none("locals"), "words", "c", "g", "x")
    asked = rows.select("cell", salt, F.lit(1).alias("kind"), "stretch", "locals", "words", *none("c", "g", "x"))
    found = _sorted(known.unionByName(asked), "cell", "salt", then=("kind",)).mapInArrow(looked_up, "stretch bigint, cell int, locals binary, c binary, g binary, x binary")
    path = _to_stretches(spark, found, "hmm-lexicon")
    dropped(words)
    n, v, once, clogc, own = mass[CLASSES:]
    return path, {"n": int(n), "v": int(v), "once": int(once), "mass": mass[:CLASSES], "c log c": clogc, "own c log c": own}


class Lexicon:
    """What is known of a stretch's words, by their numbers in it."""

    def __init__(self, path: str, stretch: int):
        t = _of_stretch(path, stretch)
        at = np.concatenate([unpacked(x, "<i4") for x in t["locals"].to_pylist()])
        columns = [np.concatenate([unpacked(x, kind) for x in t[name].to_pylist()]) for name, kind in (("c", "<i8"), ("g", "<i4"), ("x", "<i4"))]
        self.c, self.g, x = (np.empty_like(y) for y in columns)
        for y, z in zip((self.c, self.g, x), columns):
            y[at] = z
        sizes = [int.from_bytes(v[:8], "little") // 4 for v in t["locals"].to_pylist()]
        own = columns[2] >= 0
        #: own words, by cell: their locals, places in the cell, and where each cell's begin
        self.own, self.places = at[own], columns[2][own]
        self.cells, self.begin = t["cell"].to_pylist(), np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(sizes)])]
        self.unit = np.where(self.g < OFTEN, 0, self.g - OFTEN + len(self.own)).astype(np.int32)
        self.unit[self.own] = np.arange(len(self.own))

    @classmethod
    def empty(cls) -> Lexicon:
        out = cls.__new__(cls)
        out.c, out.g, out.own, out.places, out.unit = (np.zeros(0, np.int32) for _ in range(5))
        out.cells, out.begin = [], np.zeros(1, np.int64)
        return out


def _stretches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int, Lexicon, pa.RecordBatch, list[np.ndarray]]]:
    """Rows (stretch, ids, ...) by stretch: its lexicon and each document's numbers. A stretch of no words has none."""
    now, lexicon, empty = None, Lexicon.empty(), True
    for batch in batches:
        stretch = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(stretch) != 0, [True]])) if len(stretch) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = batch.slice(a, b - a)
            documents = [np.frombuffer(x, "<i4") for x in rows.column(1).to_pylist()]
            if stretch[a] != now:
                now, lexicon, empty = int(stretch[a]), Lexicon.empty(), True
            if empty and any(len(d) for d in documents):
                lexicon, empty = Lexicon(path, now), False
            yield now, lexicon, rows, documents


def _told(counts: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(counts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(counts[some, k]) for k in range(counts.shape[1]))], names=["g", *(f"c{k}" for k in range(counts.shape[1]))])


def _kinds(states: int) -> str:
    return "g int, " + ", ".join(f"c{k} double" for k in range(states))


def _summed(rows: DataFrame, size: int, states: int) -> np.ndarray:
    """Sums rows (g, c0, c1, ...) by g: `size` rows at most, CLASSES and a few."""
    got = rows.groupBy("g").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(states)]).toArrow()
    out = np.zeros((size, states))
    out[got["g"].to_numpy()] = np.stack([got[f"c{k}"].to_numpy() for k in range(states)], axis=1)
    return out


def _unknown(size: dict) -> float:
    return (size["once"] + 1) / (size["n"] + 2) if size["n"] else 0.5


def _smoothed(counts: np.ndarray, share: np.ndarray, total: np.ndarray, size: dict) -> np.ndarray:
    return (1 - _unknown(size)) * (counts + PRIOR * share[:, None]) / (total + PRIOR)


def _moves(sums: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and move parameters from rows of moves and, behind them, of first states."""
    moves, starts = sums[:states], sums[states]
    return (starts + 1) / (starts.sum() + states), (moves + 1) / (moves.sum(axis=1, keepdims=True) + states)


def _shares(size: dict) -> np.ndarray:
    share = size["mass"] / max(size["n"], 1)
    if not size["n"]:
        share[END] = 1.0
    return share


def maximised(sums: np.ndarray, size: dict, states: int) -> Model:
    """The tied model from the expected counts of classes, moves and first states."""
    counts = sums[:CLASSES]
    emit = _smoothed(counts, _shares(size), counts.sum(axis=0), size)
    emit[UNKNOWN] = _unknown(size)
    return Model(*_moves(sums[CLASSES:], states), emit)


def _gained(history: list[float]) -> bool:
    return len(history) < 2 or abs(history[-1] - history[-2]) > TOLERANCE * abs(history[-2])


def _within(size: dict, classes: slice) -> float:
    """What words' probabilities within their classes add to the training tokens' log-likelihood, but for sum(c log c)."""
    mass = size["mass"][classes]
    return -float((mass * np.log(np.maximum(mass, 1))).sum())


def _initial(held_in: DataFrame, path: str, size: dict, states: int) -> Model:
    """Documents go to the anchor that their frequent classes point to; the counts of these groups begin the states."""
    top = np.argsort(-np.where(np.arange(CLASSES) < OFTEN, size["mass"], 0.0), kind="stable")[:ANCHORS]
    place = np.full(CLASSES, -1)
    place[top] = np.arange(len(top))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        for _, lexicon, _, documents in _stretches(batches, path):
            some = [np.append(lexicon.g[d], END) for d in documents]
            out = np.zeros((len(some), len(top)))
            flat, of = place[np.concatenate(some)], np.repeat(np.arange(len(some)), [len(x) for x in some])
            out[of[flat >= 0], flat[flat >= 0]] = 1
            yield some, out

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(top), len(top)))
        for _, p in coded(batches):
            both += p.T @ p
        yield _told(both)

    both = _summed(held_in.mapInArrow(together, _kinds(len(top))), len(top), len(top))
    own = np.maximum(both.diagonal(), 1e-9)
    usual = own >= 0.01 * max(own.max(), 1)
    anchors = [int(own.argmax())]
    while len(anchors) < states:
        near = (both[anchors] / np.minimum(own[anchors][:, None], own)).max(axis=0)
        near[anchors] = np.inf
        anchors.append(int(np.where(usual, near, near + 10).argmin()))
    share = (both[anchors] + 0.5) / (own[anchors][:, None] + 1)
    given, absent, prior = np.log(share), np.log1p(-np.minimum(share, 0.999)), np.log(own[anchors])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((CLASSES + states + 1, states))
        for some, p in coded(batches):
            to = (p @ given.T + (1 - p) @ absent.T + prior).argmax(axis=1)
            for k in range(states):
                mine = [x for x, s in zip(some, to) if s == k]
                if mine:
                    counts[:CLASSES, k] += np.bincount(np.concatenate(mine), minlength=CLASSES)
                    counts[CLASSES + k, k] += sum(map(len, mine))
                    counts[CLASSES + states, k] += len(mine)
        counts[CLASSES : CLASSES + states] += counts[CLASSES : CLASSES + states].sum(axis=1, keepdims=True) * 0.02
        yield _told(counts)

    return maximised(_summed(held_in.mapInArrow(grouped, _kinds(states)), CLASSES + states + 1, states), size, states)


def _tied(held_in: DataFrame, path: str, size: dict, states: int, rounds: int) -> tuple[Model, list[float]]:
    """Baum-Welch over classes."""
    spark, model, history = held_in.sparkSession, _initial(held_in, path, size, states), []
    while len(history) < rounds:
        shared = spark.sparkContext.broadcast(model)  # CLASSES x states numbers

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            emission, counts, moves, starts, total = Emission(m.emit), np.zeros((CLASSES, states)), np.zeros((states, states)), np.zeros(states), 0.0
            for _, lexicon, _, documents in _stretches(batches, path):
                total += expected(m, emission, [np.append(lexicon.g[d], np.int32(END)) for d in documents], counts, moves, starts)
            yield _told(np.concatenate([counts, moves, starts[None], np.full((1, states), total / states)]))

        sums = _summed(held_in.mapInArrow(counted, _kinds(states)), CLASSES + states + 2, states)
        history.append((sums[-1].sum() + size["c log c"] + _within(size, slice(0, UNKNOWN))) / max(size["n"], 1))
        model = maximised(sums[:-1], size, states)
        _log.info("tied round %d: log-likelihood %.5f a token", len(history), history[-1])
        shared.unpersist()
    return model, history


class Words:
    """The model with words of their own: what of it is the same for all stretches, and where words' counts are."""

    def __init__(self, start: np.ndarray, move: np.ndarray, small: np.ndarray, total: np.ndarray, path: str | None, tied: Model | None):
        self.start, self.move, self.small, self.total, self.path, self.tied = start, move, small, total, path, tied

    def emit(self, lexicon: Lexicon, stretch: int, size: dict) -> np.ndarray:
        """Of the stretch's own words, then of the units that aren't words."""
        c = lexicon.c[lexicon.own]
        if self.tied is not None:
            g = lexicon.g[lexicon.own]
            return np.concatenate([self.tied.emit[g] * (c / size["mass"][g])[:, None], self.tied.emit[OFTEN:]])
        counts = np.zeros((0, len(self.start)))
        if len(lexicon.own):
            t = _of_stretch(self.path, stretch)
            of = dict(zip(t["cell"].to_pylist(), t["counts"].to_pylist()))  # a stretch that several tasks read has equal rows of each
            counts = np.concatenate([counts_of(of[c], len(self.start)) for c in sorted(of)])
        return np.concatenate([_smoothed(counts, c / max(size["n"], 1), self.total, size), self.small])


def _untied(documents: DataFrame, path: str, size: dict, states: int, rounds: int, tied: Model, salts: int, salt: Column) -> tuple[Words, list[float]]:
    """Baum-Welch over words of their own and the other units."""
    spark, history = documents.sparkSession, []
    now = Words(tied.start, tied.move, tied.emit[OFTEN:], np.zeros(states), None, tied)
    while len(history) < rounds and _gained(history):
        old = now.path
        now, gained = _round(documents, path, size, states, now, salts, salt)
        history.append(gained)
        _log.info("untied round %d: log-likelihood %.5f a token", len(history), history[-1])
        dropped(*([old] if old else []))
        collected(spark)
    return now, history


def _round(documents: DataFrame, path: str, size: dict, states: int, now: Words, salts: int, salt: Column) -> tuple[Words, float]:
    """One round, and the log-likelihood of a training token before it. All documents are read: a stretch of held-out ones needs its words' counts as well."""
    spark = documents.sparkSession
    packed = [("stretch", pa.int64()), ("cell", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("small", pa.binary())]
    shared = spark.sparkContext.broadcast(now)

    def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
        m, last, lexicon, counts, total = shared.value, None, None, None, 0.0
        moves, starts, small = np.zeros((states, states)), np.zeros(states), np.zeros((SMALL + 1, states))

        def done() -> pa.RecordBatch:
            own = counts[: len(lexicon.own)]
            small[:SMALL] += counts[len(lexicon.own) :]
            small[SMALL] += own.sum(axis=0)
            cells = [(last, cell, pack(lexicon.places[a:b]), pack_counts(own[a:b]), None) for cell, a, b in zip(lexicon.cells, lexicon.begin[:-1], lexicon.begin[1:]) if b > a]
            return _batch(packed, *cells)

        for stretch, lex, rows, documents in _stretches(batches, path):
            if lex is not lexicon:
                if lexicon is not None:
                    yield done()
                last, lexicon = stretch, lex
                emit = m.emit(lex, stretch, size)
                emission, counts = Emission(emit), np.zeros(emit.shape)
            end = np.int32(len(lex.own) + SMALL - 1)
            some = [np.append(lex.unit[d], end) for d, held in zip(documents, rows.column(2).to_pylist()) if not held]
            if some:
                total += expected(Model(m.start, m.move, emit), emission, some, counts, moves, starts)
        if lexicon is not None:
            yield done()
        yield _batch(packed, (None, None, None, None, pack(np.concatenate([small, moves, starts[None], np.full((1, states), total / states)]))))

    got = written(documents.mapInArrow(counted, "stretch bigint, cell int, places binary, counts binary, small binary"), "hmm-counts")
    shared.unpersist()

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((SMALL + states + 3, states))
        for (x,) in _rows(batches):
            out += unpacked(x, "<f8").reshape(out.shape)
        yield _told(out)

    sums = _summed(got.where("small IS NOT NULL").select("small").mapInArrow(small, _kinds(states)), SMALL + states + 3, states)
    gained = (sums[-1].sum() + size["c log c"] - size["own c log c"] + _within(size, slice(OFTEN, UNKNOWN))) / max(size["n"], 1)
    counts = got.where("small IS NULL").select("cell", salt, "stretch", "places", "counts")

    def added(keys: int):
        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (cell, *_), run in _grouped(batches, keys):
                whole = np.zeros((0, states))
                for places, c in run:
                    at = unpacked(places, "<i4")
                    if len(whole) <= (most := int(at.max())):
                        whole = np.concatenate([whole, np.zeros((most + 1 - len(whole), states))])
                    whole[at] += counts_of(c, states)
                yield _batch([packed[1], packed[2], packed[3]], (cell, pack(np.arange(len(whole), dtype="<i4")), pack_counts(whole)))

        return out

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for cell, _, kind, stretch, places, c in _rows(batches):
            if not kind:
                whole = counts_of(c, states)
            else:
                yield _batch([packed[0], packed[1], packed[3]], (stretch, cell, pack_counts(whole[unpacked(places, "<i4")])))

    kinds = "cell int, places binary, counts binary"
    whole = _sorted(counts.select("cell", "salt", "places", "counts"), "cell", "salt").mapInArrow(added(2), kinds)
    whole = written(whole if salts == 1 else _sorted(whole, "cell").mapInArrow(added(1), kinds), "hmm-totals")
    known = whole.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("stretch"), F.lit(None).cast("binary").alias("places"), "counts")
    asked = counts.select("cell", "salt", F.lit(1).alias("kind"), "stretch", "places", F.lit(None).cast("binary").alias("counts"))
    back = _sorted(known.unionByName(asked), "cell", "salt", then=("kind",)).mapInArrow(returned, "stretch bigint, cell int, counts binary")
    of_words = _to_stretches(spark, back, "hmm-emissions")
    total = sums[: SMALL + 1].sum(axis=0)
    share = _shares(size)[OFTEN:]
    low = _smoothed(sums[:SMALL], share, total, size)
    low[UNKNOWN - OFTEN] = _unknown(size)
    dropped(got, whole)
    return Words(*_moves(sums[SMALL + 1 :], states), low, total, of_words, None), gained


def _scored(documents: DataFrame, path: str, size: dict, model: Words) -> DataFrame:
    """Exact log10 probabilities, document by document, and the base scores."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    n, v, n_docs = size["n"], size["v"], size["docs"]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = StructType([documents.schema["doc_id"], *(StructField(k, t) for k, t in zip(names[1:], (BooleanType(), LongType(), LongType(), LongType(), DoubleType(), DoubleType())))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, now = shared.value, None
        for stretch, lex, rows, documents in _stretches(batches, path):
            if lex is not now:
                now, emit = lex, m.emit(lex, stretch, size)
                emission, model = Emission(emit, np.float64), Model(m.start, m.move, emit)
                base = np.log10((lex.c + 1) / (n + v + 1))
                rare = (lex.g >= OFTEN) & (lex.c > 0)
                inside = np.where(rare, np.log10(np.maximum(lex.c, 1) / np.maximum(size["mass"][lex.g], 1)), 0.0)
            end, end_base = np.int32(len(lex.own) + SMALL - 1), math.log10((n_docs + 1) / (n + v + 1))
            for k in range(0, len(documents), 512):
                some = documents[k : k + 512]
                logs = forward(model, emission, [np.append(lex.unit[d], end) for d in some]) / LN10
                of = [(len(d) + 1, int((lex.c[d] > 0).sum()) + (n_docs > 0), n, float(base[d].sum()) + end_base, float(inside[d].sum() + x)) for d, x in zip(some, logs)]
                part = rows.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), *(pa.array(c, t) for c, t in zip(zip(*of), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())))], names=names)

    return documents.select("stretch", "ids", "doc_id", "held_out").mapInArrow(scored, schema)


def trained(df: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, warm: int = WARM, rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """Learns from the documents whose fold isn't HELD and scores all; with each round's log-likelihood for a training token."""
    spark = df.sparkSession
    with small_batches(spark):
        rows = written(_numbered(df, key, text), "hmm-texts")
        documents, dictionary = rows.where("cell IS NULL").select("stretch", "ids", "doc_id", "held_out"), rows.where("cell IS NOT NULL")
        stretches = dictionary.select("stretch").distinct().count()
        salts, salt = _salted(stretches)
        path, size = _lexicon(dictionary, salts, salt)
        held_in = documents.where("NOT held_out").select("stretch", "ids")
        size["docs"] = held_in.count()
        size["mass"][END] = size["docs"]
        size["n"], size["v"] = size["n"] + size["docs"], size["v"] + (size["docs"] > 0)
        collected(spark)
        model, history = _tied(held_in, path, size, states, warm)
        words, more = _untied(documents.select("stretch", "ids", "held_out"), path, size, states, max(1, rounds), model, salts, salt)
        scores = written(_scored(documents, path, size, words), "hmm-scores")
        dropped(rows, path, words.path)
    return scores, history + more


def language_model(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    return trained(df, key, text, **how)[0]


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))
