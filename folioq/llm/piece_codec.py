"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A byte-pair encoding is the one path through the lattice of pieces on which every two neighbours can stand together
(see pieces.Spans.fits). So a lattice whose steps weigh 0 between neighbours that fit and -inf between others has the
library's encoding as its only path of finite weight. A giant document is cut into chunks. A boundary's states are the
pieces that end there or reach across it; a chunk gives the max-plus matrix of the best weight from each state at its
left boundary to each at its right one. Matrices are multiplied in a balanced tree, which settles the states of all
boundaries, and each chunk is then backtraced on its own. Chunks are rows, so one document's work is spread over tasks;
only the task that cuts a document, and the one that joins its ids, hold it whole. Other documents are encoded whole.

A null text is encoded like an empty one: no pieces. Repeated rows are encoded one by one. Columns of the input that
have an output's name give way to it. Decoding gives the text back, but for the piece mark U+2581, which stands for a
space in this vocabulary and comes back as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from folioq.llm.common import table, without, written
from folioq.llm.pieces import Spans, default_model, model, spans

GIANT, CHUNK, CHUNKS_A_TASK = 65_536, 16_384, 4
MARK = "▁"
State = tuple[int, int]  # code points beyond the boundary, and of the whole piece; (0, 0) before the text


def states(s: Spans, text: str, at: int, lo: int = 0) -> list[State]:
    """All pieces that start before `at` and end there or behind, in a fixed order. text begins at place lo of the whole."""
    if at == 0:
        return [(0, 0)]
    out, at = [], at - lo
    for over in range(0, s.widest):
        if at + over > len(text):
            break
        for n in range(over + 1, s.widest + 1):
            if n <= at + over and (n == 1 or text[at + over - n : at + over] in s.ids):
                out.append((over, n))
    return out


def _steps(s: Spans, text: str, left: int, right: int, nodes: dict[int, dict[int, int]], lo: int) -> dict[int, dict[int, int]]:
    """nodes[place][length]: the set of the first nodes' states, as bits, from which a path reaches the piece that ends at place."""
    ids, tails, known, fits = s.ids, s.tails, s.known, s.fits
    left, right = left - lo, right - lo
    for end in range(left + 1, min(len(text), right + s.widest - 1) + 1):
        here = nodes.get(end + lo) or {}
        for n in range(1, end - left + 1):
            start = end - n
            piece = text[start:end]
            if n > 1 and piece not in tails:
                break  # no piece ends like this, so no longer one does
            if start >= right or not (before := nodes.get(start + lo)) or (n > 1 and piece not in ids):
                continue
            bits = 0
            for m, b in before.items():
                if not m:
                    bits |= b
                else:
                    pair = (text[start - m : start], piece)
                    fit = known.get(pair)
                    if fit or fit is None and fits(*pair):
                        bits |= b
            if bits:
                here[n] = here.get(n, 0) | bits
        if here:
            nodes[end + lo] = here
    return nodes


def transfer(s: Spans, text: str, left: int, right: int, lo: int = 0) -> np.ndarray:
    """The max-plus matrix of the chunk from left to right: 0 where a path leads from state to state, else -inf."""
    begin: dict[int, dict[int, int]] = {}
    sources = states(s, text, left, lo)
    for k, (over, n) in enumerate(sources):
        begin.setdefault(left + over, {})[n] = 1 << k
    nodes = _steps(s, text, left, right, begin, lo)
    goals = states(s, text, right, lo)
    out = np.full((len(sources), len(goals)), -np.inf)
    for j, (over, n) in enumerate(goals):
        bits = nodes.get(right + over, {}).get(n, 0)
        out[[k for k in range(len(sources)) if bits >> k & 1], j] = 0.0
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: associative, so chunks can be multiplied in any grouping."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def settle(matrices: list[np.ndarray], source: int, goal: int) -> list[int]:
    """The states of the inner boundaries on the best path from source to goal."""
    tree: dict[tuple[int, int], np.ndarray] = {}

    def product(i: int, j: int) -> np.ndarray:
        if j - i == 1:
            return matrices[i]
        if (i, j) not in tree:
            tree[i, j] = combine(product(i, (i + j) // 2), product((i + j) // 2, j))
        return tree[i, j]

    def inner(i: int, j: int, a: int, b: int) -> list[int]:
        if j - i == 1:
            return []
        m = (i + j) // 2
        weight = product(i, m)[a] + product(m, j)[:, b]
        mid = int(weight.argmax())
        if weight[mid] == -np.inf:
            raise ValueError("no path through the lattice")
        return [*inner(i, m, a, mid), mid, *inner(m, j, mid, b)]

    return inner(0, len(matrices), source, goal)


def backtrace(s: Spans, text: str, left: int, right: int, source: State, goal: State, lo: int = 0) -> list[int]:
    """Ids of the pieces that start within the chunk, on the path between the two states."""
    nodes = _steps(s, text, left, right, {left + source[0]: {source[1]: 1}}, lo)
    at, n, pieces = right + goal[0], goal[1], []
    while at > left + source[0]:
        pieces.append(piece := text[at - n - lo : at - lo])
        at -= n
        n = next(m for m in nodes[at] if not m or s.fits(text[at - m - lo : at - lo], piece))
    return [i for p in reversed(pieces) for i in ids_of(s, p)]


def ids_of(s: Spans, piece: str) -> list[int]:
    if (i := s.ids.get(piece)) is not None:
        return [i]
    return [int(i) for i in s.encode(piece)[0]]  # a character beyond the vocabulary: its bytes


def _chunks(n: int, chunk: int) -> list[tuple[int, int]]:
    return [(a, min(a + chunk, n)) for a in range(0, n, chunk)]


def scan_encode(s: Spans, text: str, chunk: int = CHUNK) -> list[int]:
    """What the distributed form does, in one process (for tests and for single texts)."""
    norm = (MARK + text).replace(" ", MARK) if text else ""
    cuts = _chunks(len(norm), max(chunk, s.widest))
    if not cuts:
        return []
    ends = states(s, norm, len(norm))
    matrices = [transfer(s, norm, a, b) for a, b in cuts]
    total = matrices[0]
    for m in matrices[1:]:
        total = combine(total, m)
    goal = int(total[0].argmax())
    at = [0, *settle(matrices, 0, goal), goal]
    found = [(0, 0)] + [states(s, norm, b)[at[k + 1]] for k, (_, b) in enumerate(cuts[:-1])] + [ends[goal]]
    return [i for k, (a, b) in enumerate(cuts) for i in backtrace(s, norm, a, b, found[k], found[k + 1])]


def encode(df: DataFrame, text: str = "text", path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """df with piece_ids array<int>, n_tokens and n_chunks."""
    path = path or default_model()
    df = without(df, "piece_ids", "n_tokens", "n_chunks")
    added = [StructField("piece_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("n_chunks", LongType())]
    names = [*df.columns, "piece_ids", "n_tokens", "n_chunks"]
    where, size = df.columns.index(text), F.coalesce(F.length(f"`{text}`"), F.lit(0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = model(path).encode([t or "" for t in part.column(where).to_pylist()], num_threads=1)
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                flat = np.concatenate([np.array(x, dtype=np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                new = [lists, pa.array(sizes), pa.array(np.ones(len(ids), np.int64))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    small = df.where(size <= giant).mapInArrow(whole, StructType([*df.schema.fields, *added]))
    return small.unionByName(_scanned(df.where(size > giant), text, path, chunk))


def _scanned(df: DataFrame, text: str, path: str, chunk: int) -> DataFrame:
    """The giant documents of df, encoded by chunks."""
    row = "_folioq_row"
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), "giants")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = spans(path).widest
        for batch in batches:
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                norm = (MARK + t).replace(" ", MARK)
                cuts = _chunks(len(norm), max(chunk, halo))
                for k, (a, b) in enumerate(cuts):
                    lo = max(0, a - halo)
                    yield pa.RecordBatch.from_pylist([{row: r, "k": k, "n": len(cuts), "lo": lo, "left": a, "right": b, "part": norm[lo : b + halo]}], schema=pa.schema([(row, pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("lo", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("part", pa.string())]))

    parts = rows.select(row, text).mapInArrow(cut, f"{row} bigint, k int, n int, lo bigint, `left` bigint, `right` bigint, part string")
    parts = written(parts, "chunks")
    # a chunk takes some tenths of a second: tasks follow the number of chunks, not their few bytes
    n = max(2, -(-parts.count() // CHUNKS_A_TASK))
    parts = parts.repartition(n, row, "k")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = spans(path)
        for f in frames:
            out = []
            for x in f.itertuples(index=False):
                # a boundary's states depend on the text around it alone, so both of its chunks number them alike
                m = transfer(s, x.part, x.left, x.right, x.lo)
                out.append((x[0], x.k, x.n, m.shape[1], np.packbits(m == 0.0).tobytes(), m.shape[0]))
            yield pd.DataFrame(out, columns=[row, "k", "n", "goals", "bits", "sources"])

    steps = parts.mapInPandas(matrices, f"{row} bigint, k int, n int, goals int, bits binary, sources int")

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        ms = [np.where(np.unpackbits(np.frombuffer(b, np.uint8), count=i * j).reshape(i, j).astype(bool), 0.0, -np.inf) for b, i, j in zip(f["bits"], f["sources"], f["goals"])]
        vector = ms[0][0]
        for m in ms[1:]:
            vector = (vector[:, None] + m).max(axis=0)
        goal = int(vector.argmax())
        at = [0, *settle(ms, 0, goal), goal]
        return pd.DataFrame({row: f[row].to_numpy(), "k": f["k"].to_numpy(), "source": at[:-1], "goal": at[1:]})

    chosen = steps.groupBy(row).applyInPandas(joined, f"{row} bigint, k int, source int, goal int")

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = spans(path)
        for f in frames:
            ids = []
            for x in f.itertuples(index=False):
                source, goal = states(s, x.part, x.left, x.lo)[x.source], states(s, x.part, x.right, x.lo)[x.goal]
                ids.append(backtrace(s, x.part, x.left, x.right, source, goal, x.lo))
            yield pd.DataFrame({row: f[row], "k": f["k"], "ids": ids})

    ids = parts.join(chosen.repartition(n, row, "k"), [row, "k"]).mapInPandas(traced, f"{row} bigint, k int, ids array<int>")
    ids = ids.groupBy(row).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("piece_ids"), F.count("*").alias("n_chunks"))
    return rows.join(ids, row).drop(row).withColumn("n_tokens", F.size("piece_ids").cast("long"))


def decoder(path: str):
    s = spans(path)
    raw = [bytes([int(p[3:5], 16)]) if s.is_byte[i] else b"" if s.sp.is_control(i) else p.encode() for i, p in enumerate(s.pieces)]
    return lambda ids: b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


def decode(df: DataFrame, ids: str = "piece_ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of its ids; null ids give an empty text."""
    path = path or default_model()
    df = without(df, name)
    names, where = [*df.columns, name], df.columns.index(ids)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = decoder(path)
        for batch in batches:
            column = batch.column(where)
            flat, cuts, absent = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_null().to_pylist()
            texts = ["" if gone else decoded(flat[a:b].tolist()) for a, b, gone in zip(cuts[:-1].tolist(), cuts[1:].tolist(), absent)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(told, StructType([*df.schema.fields, StructField(name, StringType())]))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return back.select("doc_id", "n_tokens", "n_chunks", F.xxhash64("piece_ids").alias("ids_digest"), F.length("decoded").cast("long").alias("n_chars"), same.alias("round_trip"))
