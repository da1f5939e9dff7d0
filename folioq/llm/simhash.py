"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints of whole texts are made distinct first, so copies of a text are one class and never form pairs. Two
fingerprints that differ in at most two bits agree in one of three blocks of their bits, and of what remains in one of
three blocks again: each class goes to nine tables, keyed by the bits that must agree. In a table's part, fingerprints
(the agreeing bits in front) are sorted by Gray rank, so that neighbours share most bits. Every eight neighbours form a
node that holds the bits that all have in common, less those that its parent holds already; a search sums up the
differences from node to node on the way down, and leaves out whole groups once there are more than allowed. A part
yields a spanning forest of its links, at most one row per fingerprint, and star contraction joins the forests. A
fingerprint has at most 2080 others within two bits, so the work stays in proportion however large a group of copies.

To keep one of each group of similar texts (`deduplicated`), the index's links of five-word fingerprints come first, each
held against the texts' whole sets of shingles. Fingerprints within two bits miss texts that gained or lost a passage, so
what is not linked yet is looked for among the rarest shingles of each text (a prefix filter, complete for the
similarity), and each such pair is compared by its whole sets, too. Copies are one class there too; large groups are
linked by a few texts, so that their pairs aren't listed.

Words are what stands between blanks (space, tab to carriage return), A-Z lower-cased; a text of fewer words than a
shingle has is one shingle; null and empty texts have no words, fingerprint zero, and are linked like any other.
Repeated rows share a class. A null doc_id can't name a component that has other ids; a component of none but null ids
has a null component_id. An empty table gives no rows. Columns of the input that have an output's name give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioq.llm.common import collected, dropped, packed, partitions, small_batches, table, unpacked, without, written

SHINGLE, RADIUS, SEED = 3, 2, 42
FAN, ROWS, QUERIES = 8, 200_000, 8_192
#: Shingles of texts that are dealt out at once.
PACK = 1_000_000
#: For similar texts: words to a shingle.
LONG = 5
MASK64 = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, repeats included. Signed, as Spark's bigint."""
    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), 0
    hashes = np.array([digest(p, SEED) for p in parts], dtype=">u8")
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int(np.packbits(total * 2 > n).view(">i8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """df's columns with the text as fingerprint `name`; one pass without a shuffle."""
    rest = without(df.drop(text), name).columns
    schema = StructType([*(df.schema[c] for c in rest), StructField(name, LongType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(fps, pa.int64())], names=[*rest, name])

    return df.select(*[f"`{c}`" for c in rest], F.col(f"`{text}`").cast("binary")).mapInArrow(made, schema)


def _blocks(bits: int) -> list[tuple[int, int]]:
    """Three blocks (shift, width), the highest first."""
    low = bits // 3
    mid = (bits - low) // 2
    return [(low + mid, bits - low - mid), (low, mid), (0, low)]


@lru_cache(maxsize=4)
def tables(bits: int = 64) -> list[list[tuple[int, int]]]:
    """For each table, fields (shift, width) of a fingerprint: first those that must agree (two of them), then the rest."""
    out, blocks = [], _blocks(bits)
    for k, block in enumerate(blocks):
        rest = [(shift + width - i - 1, 1) for shift, width in blocks[:k] + blocks[k + 1 :] for i in range(width)]
        thirds = [rest[: len(rest) // 3], rest[len(rest) // 3 : 2 * len(rest) // 3], rest[2 * len(rest) // 3 :]]
        for j, third in enumerate(thirds):
            out.append(_runs([block, *third]) + _runs([x for t in thirds[:j] + thirds[j + 1 :] for x in t]))
    return out


def _runs(fields: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjoining fields as one."""
    out = fields[:1]
    for shift, width in fields[1:]:
        if out[-1][0] == shift + width:
            out[-1] = (shift, out[-1][1] + width)
        else:
            out.append((shift, width))
    return out


def _key_mask(k: int, bits: int = 64) -> int:
    """Of table k, the bits that must agree."""
    size = _blocks(bits)[k // 3][1]
    rest = bits - size
    left, mask = size + (rest // 3, 2 * rest // 3 - rest // 3, rest - 2 * rest // 3)[k % 3], 0
    for shift, width in tables(bits)[k]:
        take = min(width, left)
        mask |= ((1 << take) - 1) << (shift + width - take)
        left -= take
    return mask


def permuted(fps: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for shift, width in fields:
        out = (out << np.uint64(width)) | ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Where each value stands in the reflected Gray sequence."""
    out = values.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """Sorted, distinct fingerprints under a hierarchy of shared masked bit patterns."""

    def __init__(self, values: np.ndarray):
        """values: in Gray order."""
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, high = values, values
        patterns = [(values, np.zeros(len(values), dtype=np.uint64))]  # pattern, bits that vary below
        while len(low) > FAN:
            at = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            patterns.append((low, low ^ high))
        for k, (pattern, varies) in enumerate(patterns):
            above = np.repeat(patterns[k + 1][1], FAN)[: len(pattern)] if k + 1 < len(patterns) else np.full(len(pattern), MASK64, dtype=np.uint64)
            self.levels.append((pattern, ~varies & above, np.bitwise_count(varies).astype(np.int64)))  # own bits: fixed here, not above

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions that connect, through each other, all that lie within radius."""
        n, top = len(self.levels[0][0]), len(self.levels) - 1
        for first in range(0, n, QUERIES):
            q = np.arange(first, min(n, first + QUERIES))
            roots = np.arange(len(self.levels[top][0]))
            query, node, off = np.repeat(q, len(roots)), np.tile(roots, len(q)), np.zeros(len(q) * len(roots), dtype=np.int64)
            for level in range(top, -1, -1):
                pattern, own, varying = self.levels[level]
                width = FAN**level
                keep = (node + 1) * width - 1 > query  # pairs are found from their first position
                query, node, off = query[keep], node[keep], off[keep]
                off = off + np.bitwise_count((self.levels[0][0][query] ^ pattern[node]) & own[node])
                keep = off <= radius
                query, node, off = query[keep], node[keep], off[keep]
                if not level:
                    yield query, node
                    break
                # all below are within reach, and of each other: one link and the group's own chain say so
                whole = (off + varying[node] <= radius) & (node * width > query)
                if whole.any():
                    yield query[whole], node[whole] * width
                    for g in np.unique(node[whole]):
                        chain = np.arange(g * width, min(n, (g + 1) * width))
                        yield chain[:-1], chain[1:]
                    query, node, off = query[~whole], node[~whole], off[~whole]
                below = len(self.levels[level - 1][0])
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, off = np.repeat(query, FAN), np.repeat(off, FAN)
                keep = node < below
                query, node, off = query[keep], node[keep], off[keep]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """For each position, the root of its component; pairs are folded in as they come, into `root` if there is one."""
    root = np.arange(n) if root is None else root
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = lo < hi
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(root, hi[open_], lo[open_])
            while (root != (up := root[root])).any():
                root = up
    return root


def _linked(radius: int, bits: int = 64):
    """Forests of the rows (key, t, fp), sorted by key; a key's rows are of one table t."""
    fields = tables(bits)

    def part(t: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = permuted(fps.view(np.uint64), fields[t])
        order = np.argsort(gray_rank(values), kind="stable")
        fps = fps[order]
        root = forest(len(fps), GrayIndex(values[order]).links(radius))
        leaf = root != np.arange(len(fps))
        return fps[leaf], fps[root[leaf]]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of rows ends where the key does."""
        for _, t, fp in _whole(batches):
            for k in np.unique(t):
                a, b = part(int(k), fp[t == k])
                if len(a):
                    yield _batch(a=a, b=b)

    return linked


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `fp` within radius (2 at most) of each other."""
    if radius > RADIUS:
        raise ValueError(f"the tables find differences of up to {RADIUS} bits")
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(_key_mask(k)))).alias("key")) for k in range(9)])
    keyed = classes.select("fp", F.explode(rows).alias("k")).select(F.xxhash64("k.t", "k.key").alias("key"), "k.t", "fp")
    # the rows are small and the search is not: tasks follow the rows' number, not their bytes
    n = max(partitions(classes.sparkSession), -(-9 * classes.count() // ROWS))
    keyed = keyed.repartition(n, "key").sortWithinPartitions("key")
    return keyed.mapInArrow(_linked(radius), "a bigint, b bigint")


def contract(edges: DataFrame) -> DataFrame:
    """Stars (node, root) of the components of edges (a, b), by alternating large-star and small-star steps.

    Each round is written to the shared folder, and the one before it removed. The join with the minimum of a node is one
    that AQE splits by size.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    mark = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or (state["n"], state["h"]) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (state["n"], state["h"])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        large, old = written(large, "large-star"), edges
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.where("a <> b").distinct(), "small-star")
        dropped(old, large)


def components(fps: DataFrame, least: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, component): for each distinct fingerprint of fps, the least value of its component."""
    classes = written(fps.groupBy("fp").agg(F.min(least).alias("least")), "classes")
    return _joined(classes, links(classes, radius))


def _joined(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component) of classes (fp, least) that edges (a, b) of their fp connect."""
    stars = contract(edges)
    nodes = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    own = written(nodes.join(classes, nodes["node"] == classes["fp"]).select("node", "root", "least"), "component-nodes")
    of_root = own.groupBy("root").agg(F.min("least").alias("component"))
    linked = unpacked(packed(own.select("root", "node"), "root").join(of_root, "root")).select(F.col("node").alias("fp"), "component")
    return classes.select("fp", "least").join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) of every row."""
    fps = written(fingerprints(df.select(key, text), text, shingle), "fingerprints")
    found = components(fps, F.col(key), radius)
    return unpacked(packed(fps, "fp").join(found, "fp")).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingles(text: bytes) -> np.ndarray:
    """The distinct five-word shingles of a text as sorted 64-bit hashes; a shorter text that has words is one shingle."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < LONG:
        return np.array([digest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    of = {w: digest(w, SEED) for w in set(words)}
    hashes = np.fromiter((of[w] for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - LONG + 1, dtype=np.uint64)
    for k in range(LONG):
        out = (out + hashes[k : len(out) + k]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _least(sizes: np.ndarray, share: float) -> np.ndarray:
    """The least whole numbers that are at least so large a share of sizes."""
    return np.ceil(share * sizes - 1e-9).astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, in blocks that end where its value does."""
    parts: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held += batch.num_rows
        last = parts[-1][0]
        if held >= ROWS and (last[0] != last[-1] or (len(parts) > 1 and parts[-2][0][-1] != last[0])):
            have = [np.concatenate(x) for x in zip(*parts)]
            cut = int(np.flatnonzero(have[0][1:] != have[0][:-1])[-1]) + 1
            yield [x[:cut] for x in have]
            parts, held = [[x[cut:] for x in have]], len(have[0]) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*parts)]


def _lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys start, and their lengths."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return at, np.diff(np.append(at, len(keys)))


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], names=list(columns))


def _dealt(tokens: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, ids) of shingles and their texts: the leading bits of the hash, the next 32 of all in that bucket, their texts' ids.

    Ids go as steps from one to the next, all lowest bytes first: mostly zeros, which the shuffle's compression takes out.
    """
    for k in range(0, len(tokens), PACK):
        token, own = tokens[k : k + PACK], ids[k : k + PACK]
        bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, own, key = bucket[order], own[order], (token[order] >> np.uint64(32 - bits)).astype("<u4")
        at, counts = _lengths(bucket)
        steps = np.diff(own, prepend=0).astype("<i8")
        steps[at] = own[at]
        runs = [(a, a + n) for a, n in zip(at.tolist(), counts.tolist())]
        columns = pa.array(bucket[at]), pa.array([key[a:z].tobytes() for a, z in runs], pa.binary()), pa.array([steps[a:z].view(np.uint8).reshape(-1, 8).T.tobytes() for a, z in runs], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns), names=["bucket", "keys", "ids"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens (bucket and key) and ids of the rows that `_dealt` makes, sorted by bucket: a whole bucket at a time."""
    last, keys, ids = None, [], []
    for batch in batches:
        for bucket, key, steps in zip(*(c.to_pylist() for c in batch.columns)):
            if keys and bucket != last:
                yield (last << 32) + np.concatenate(keys), np.concatenate(ids)
                keys, ids = [], []
            last = bucket
            keys.append(np.frombuffer(key, "<u4").astype(np.int64))
            ids.append(np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(8, -1).T).view("<i8").ravel()))
    if keys:
        yield (last << 32) + np.concatenate(keys), np.concatenate(ids)


def _postings(texts: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(token, id, size, pos): the shingles of each text (id, text; sizes: id, size) by which a similar one must be found, rarest first.

    Two sets of the similarity have, in any common order, a shingle in common among the first size - least(size) + 1 of
    each. The order here is by the number of texts, then the token: a shingle of one text only is counted, no more.

    Most shingles are of one text, and all must go out to be counted: they go in buckets, as a few bytes each. A token is
    the bucket and 32 bits of the hash. Shingles that share a token are counted as one, which is a common order still: the
    shingle that two texts must share has its token among the first of both.
    """
    spark = texts.sparkSession
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bits = min(31, max(8 * partitions(spark), -(-total // ROWS)).bit_length())

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, n = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                sets.append(shingles((t.as_py() or "").encode()))
                ids.append(i)
                n += len(sets[-1])
                if n >= PACK:
                    yield from _dealt(np.concatenate(sets), np.repeat(ids, [len(x) for x in sets]), bits)
                    ids, sets, n = [], [], 0
        if n:
            yield from _dealt(np.concatenate(sets), np.repeat(ids, [len(x) for x in sets]), bits)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, ids in _buckets(batches):
            order = np.argsort(token, kind="stable")
            token, ids = token[order], ids[order]
            n = np.repeat(counts := _lengths(token)[1], counts)
            yield _batch(id=ids[n > 1], n=n[n > 1], token=token[n > 1])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, token, size in _whole(batches):
            at, counts = _lengths(ids)
            pos = np.arange(len(ids)) - np.repeat(at + counts, counts) + size  # behind those that no other text has
            keep = pos < size - _least(size, similarity) + 1
            yield _batch(token=token[keep], id=ids[keep], size=size[keep], pos=pos[keep])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, ids, size, pos in _whole(batches):
            keep = np.repeat(counts := _lengths(token)[1], counts) > 1
            yield _batch(token=token[keep], id=ids[keep], size=size[keep], pos=pos[keep])

    out = texts.mapInArrow(all_, "bucket bigint, keys binary, ids binary").repartition("bucket").sortWithinPartitions("bucket")
    out = out.mapInArrow(shared, "id bigint, n bigint, token bigint").join(sizes, "id").select("id", "n", "token", "size").repartition("id").sortWithinPartitions("id", "n", "token")
    out = out.mapInArrow(first, "token bigint, id bigint, size bigint, pos bigint").repartition("token").sortWithinPartitions("token")
    with small_batches(spark, 10_000):
        return written(out.mapInArrow(several, "token bigint, id bigint, size bigint, pos bigint"), "postings")


def _candidates(similarity: float, low: int, high: int):
    """Pairs (a, b) from postings sorted by token and id: each one's texts from place low to high with all behind them.

    Left out are pairs whose texts are linked already, and those that sizes and places show to be below the similarity.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, ids, size, pos, root in _whole(batches):
            a, b, n = [], [], 0
            for at, count in zip(*_lengths(token)):
                for k in range(at + low, at + min(high, count - 1)):
                    j = np.arange(k + 1, at + count)
                    common = np.minimum(size[k] - pos[k], size[j] - pos[j])
                    j = j[(root[j] != root[k]) & (common >= _least(size[k] + size[j], similarity / (1 + similarity)))]
                    a.append(np.full(len(j), ids[k]))
                    b.append(ids[j])
                    n += len(j)
                    if n >= ROWS:
                        yield _batch(a=np.concatenate(a), b=np.concatenate(b))
                        a, b, n = [], [], 0
            if n:
                yield _batch(a=np.concatenate(a), b=np.concatenate(b))

    return found


def _similar(similarity: float):
    """Of pairs (a, b, text of a, text of b), those whose sets of shingles are similar by Jaccard."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k, a in enumerate(left):
                if a != last:
                    last, x = a, shingles((batch.column(2)[k].as_py() or "").encode())
                y = shingles((batch.column(3)[k].as_py() or "").encode())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            keep = np.array(keep, dtype=bool)
            yield _batch(a=np.array(left, np.int64)[keep], b=np.array(right, np.int64)[keep])

    return similar


def _compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of texts (id, text), those of the similarity."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    with small_batches(texts.sparkSession, 500):
        return written(both.mapInArrow(_similar(similarity), "a bigint, b bigint"), "similar")


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of distinct shingles' hashes, signed."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">i8")[0])


def _near_fingerprints(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes (id, print): of equal fingerprints with the first, and firsts that the Gray-order index links."""
    firsts = written(classes.groupBy(F.col("print").alias("fp")).agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts")
    equal = unpacked(packed(classes.select("print", "id"), "print").join(firsts.where("n > 1").select(F.col("fp").alias("print"), "first"), "print")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = links(firsts.select("fp")).toDF("x", "y").join(firsts.select(F.col("fp").alias("x"), F.col("first").alias("a")), "x").join(firsts.select(F.col("fp").alias("y"), F.col("first").alias("b")), "y")
    return equal.unionByName(near.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar_links(texts: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all texts (id, text) of the similarity, each edge between two of it, by rounds.

    sizes: (id, size, print). The first edges are those that fingerprints show. Then a round compares the next 1, 4, 16, ... texts of each shingle with all behind them that aren't linked with them yet:
    a large group of near copies is linked by its first texts, so its pairs are never listed.
    """
    spark = texts.sparkSession
    postings = _postings(texts, sizes.select("id", "size"), similarity)
    collected(spark)  # the postings' shuffles are several times the texts
    near = written(postings.select("id").distinct(), "near-ids")
    texts = written(texts.join(near, "id", "left_semi"), "near-texts", "zstd")
    dropped(near)
    edges, low, step = _compared(_near_fingerprints(sizes.select("id", "print")), texts, similarity), 0, 1
    while True:
        stars = contract(edges)
        own = postings.join(stars, postings["id"] == stars["node"], "left").select("token", "id", "size", "pos", F.coalesce("root", "id").alias("root"))
        left = own.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where(f"x < y AND n > {low + 1}").select("token")
        open_ = written(own.join(left, "token", "left_semi"), "open-postings")
        if open_.isEmpty():
            dropped(postings, texts, open_)
            return stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
        pairs = open_.repartition("token").sortWithinPartitions("token", "id").mapInArrow(_candidates(similarity, low, low + step), "a bigint, b bigint").distinct()
        found = _compared(pairs, texts, similarity)
        dropped(open_)
        del own, left, open_, pairs
        collected(spark)
        edges = found.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))
        low, step = low + step, step * 4


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """df with one row of each group of texts whose five-word shingles are similar: that of the smallest key, nulls last, of equal ones any.

    Similarity is that of sets, by Jaccard, of 64-bit hashes. Texts of equal sets are made one class beforehand; every
    pair of classes of the similarity shares one of its rarest shingles, and each pair that does is compared whole, unless
    it's linked already.
    """
    row, one, two, size, print_ = "_folioq_row", "_folioq_one", "_folioq_two", "_folioq_size", "_folioq_print"
    names = df.columns
    at = names.index(text)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = []
            for t in batch.column(at):
                hashes = shingles((t.as_py() or "").encode())
                raw = hashes.tobytes()
                sketches.append((signed(xxhash.xxh64_intdigest(raw, SEED)), signed(xxhash.xxh64_intdigest(raw, SEED + 1)), len(hashes), _majority(hashes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in sketches], pa.int64()) for k in range(4))], names=[*names, one, two, size, print_])

    rows = df.mapInArrow(sketched, StructType([*df.schema.fields, *(StructField(c, LongType()) for c in (one, two, size, print_))]))
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "rows", "zstd")
    least = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(row).alias("row"))
    classes = rows.select(one, two, size, print_, least.alias("_least")).groupBy(one, two).agg(F.min("_least").alias("least"), F.min(size).alias("size"), F.min(print_).alias("print"))
    classes = written(classes.withColumn("fp", F.col("least.row")), "classes")
    # few rows go: where their ids are few enough for Spark to broadcast, no text is shuffled
    copies = written(rows.select(row, one, two).join(classes.select(one, two, "fp"), [one, two]).where(F.col(row) != F.col("fp")).select(row), "copies")
    texts = rows.join(copies, row, "left_anti").select(F.col(row).alias("id"), F.col(f"`{text}`").alias("text"))
    edges = _similar_links(texts, classes.select(F.col("fp").alias("id"), "size", "print"), similarity)
    gone = _joined(classes, edges).where("component.row <> fp").select(F.col("fp").alias(row))
    return rows.join(written(gone.unionByName(copies), "gone"), row, "left_anti").select(*[f"`{c}`" for c in names])


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
