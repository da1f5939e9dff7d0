"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by a hash), offered as often as the cap allows. A turn of a
document is served in quanta of QUANTUM words; a quantum's virtual finish is the words that its source has served by its
end, over the source's target. All quanta are range-sorted by virtual finish, the sorted partitions' words are summed up
one after the other, and where the sum reaches the total budget the mix is truncated: the last quantum is taken in part.

Prefix sums don't gather a source: its documents are split by the leading bits of their hash, each split is summed, the
few sums are accumulated, and a running sum inside each split is added. Targets are settled by sums over sources, too.

A null source is a source of its own (last in order), a null text has no words and is never taken; repeated rows are
documents of their own; a source whose documents are all empty has target 0. An empty table gives an empty mix. Columns
of the input that have an output's name give way to it. In the mix of documents (`mixed`), a turn of which the budget
leaves less than half is left out, and one of which it leaves half or more is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from folioq.llm.common import let, partitions, table, without, written

WEIGHTS, SHARE, CAP, SEED, SPLIT_BITS, QUANTUM = (5, 2, 1), 1.5, 2, 17, 8, 128
ROW = "_folioq_row"
_BLANK = " \t\n\x0b\f\r"
ADDED = ("size", "source_size", "target", "turns", "taken", "virtual_finish")


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return let(trimmed, lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+")))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row per source (nul, src, source_size): its target, min(cap * size, level * weight), the level set by the budget.

    The level at which no target exceeds its cap while all add up to the budget is where resharing the excess by weight
    ends. It is found by rounds, each one sum over the sources: those over their cap at the present level are settled.
    """
    spark, n = sizes.sparkSession, len(weights)
    order = ["nul", "src"]
    ranked = written(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "mix-sources")
    # a source's place in the order: its place in its partition behind all partitions before; ids say both
    counts = sorted((r["p"], r["n"]) for r in ranked.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    starts, so_far = [], 0
    for p, k in counts:
        starts.append((p, so_far))
        so_far += k
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = ranked.withColumn("p", F.shiftright("_id", 33)).join(F.broadcast(spark.createDataFrame(starts, "p bigint, start bigint")), "p")
    rows = rows.select(*order, "source_size", F.element_at(cycle, (F.pmod(place, F.lit(n)) + 1).cast("int")).alias("weight"), (F.col("source_size") * float(cap)).alias("most"))
    budget, level = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * share, 0.0
    while True:
        over = F.col("most") <= F.lit(level) * F.col("weight")
        got = rows.agg(F.sum(F.when(over, F.col("most"))).alias("settled"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not got["weight"]:
            level = float("inf")
            break
        now = max(level, (budget - (got["settled"] or 0.0)) / got["weight"])
        if now <= level * (1 + 1e-12):
            break
        level = now
    return rows.select(*order, "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def schedule(rows: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, split_bits: int = SPLIT_BITS, quantum: int = QUANTUM) -> tuple[DataFrame, DataFrame]:
    """Of rows (ROW, source, size, order_key): the words taken (ROW, epoch, words, virtual_finish), and what each source is due.

    The second table has a row (nul, src, source_size, target) per source. Rows of which nothing is taken are not in the first.
    """
    spark = rows.sparkSession
    keyed = rows.select(ROW, "size", "order_key", F.col(source).isNull().alias("nul"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.shiftrightunsigned("order_key", 64 - split_bits).alias("split"))
    splits = keyed.groupBy("nul", "src", "split").agg(F.sum("size").alias("split_size"))
    w = Window.partitionBy("nul", "src").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(splits.withColumn("offset", F.coalesce(F.sum("split_size").over(w), F.lit(0))), "mix-splits")
    due = written(targets(splits.groupBy("nul", "src").agg(F.sum("split_size").alias("source_size")), weights, share, cap), "mix-targets")
    total = splits.agg(F.sum("split_size")).first()[0] or 0
    budget = int(total * min(share, cap))

    inside = Window.partitionBy("nul", "src", "split").orderBy("order_key", "size", ROW).rowsBetween(Window.unboundedPreceding, 0)
    ended = keyed.where("size > 0").withColumn("ended", F.sum("size").over(inside)).join(splits, ["nul", "src", "split"]).join(due.where("target > 0"), ["nul", "src"])
    epochs = F.explode(F.array(*[F.lit(e) for e in range(cap)])).alias("epoch")
    turns = ended.select(ROW, "order_key", "nul", "src", "size", "target", epochs, (F.col("offset") + F.col("ended") - F.col("size")).alias("before"), "source_size")
    quanta = turns.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / quantum).cast("long"))).alias("q"))
    upto = F.least((F.col("q") + 1) * quantum, F.col("size"))
    finish = (F.col("before") + F.col("epoch") * F.col("source_size") + upto) / F.col("target")
    quanta = quanta.select(finish.alias("virtual_finish"), "nul", "src", "order_key", ROW, "epoch", (upto - F.col("q") * quantum).alias("words"))
    order = ["virtual_finish", "nul", "src", "order_key", ROW, "epoch"]
    sorted_ = quanta.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = StructType([*(quanta.schema[c] for c in ("virtual_finish", ROW, "epoch", "words")), StructField("part", IntegerType()), StructField("sum", LongType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                running = pc.add(pc.cumulative_sum(batch.column(3)), done)
                done = running[-1].as_py()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), running], names=schema.names)

    served = written(sorted_.select("virtual_finish", ROW, "epoch", "words").mapInArrow(summed, schema), "mix-order")
    offsets, so_far = [], 0
    for r in sorted(served.groupBy("part").agg(F.max("sum").alias("n")).collect()):  # a row per partition
        offsets.append((r["part"], so_far))
        so_far += r["n"]
    starts = spark.createDataFrame(offsets, "part int, `offset` bigint")
    left = F.lit(budget) - (F.col("offset") + F.col("sum") - F.col("words"))
    cut = served.join(F.broadcast(starts), "part").select("virtual_finish", ROW, "epoch", F.least("words", left).alias("words")).where("words > 0")
    return cut.groupBy(ROW, "epoch").agg(F.sum("words").alias("words"), F.max("virtual_finish").alias("virtual_finish")), due


def sized(df: DataFrame, text: str = "text", keys: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """df with ROW, each document's size in words, and its place in the shuffled order."""
    return without(df, *ADDED, "order_key", ROW).withColumns({"size": word_count(F.col(text)), "order_key": F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], F.col(text)), ROW: F.monotonically_increasing_id()})


def mix(rows: DataFrame, source: str = "source", **how) -> DataFrame:
    """rows (as `sized` makes them, written) with ADDED: what is taken of each document, repeats counted."""
    taken, due = schedule(rows, source, **how)
    each = taken.groupBy(ROW).agg(F.sum("words").alias("taken"), F.count("*").alias("turns"), F.min("virtual_finish").alias("virtual_finish"))
    known = rows.withColumns({"_nul": F.col(source).isNull(), "_src": F.coalesce(F.col(source), F.lit(""))}).join(due.toDF("_nul", "_src", "source_size", "target"), ["_nul", "_src"]).drop("_nul", "_src")
    return known.join(each, ROW, "left").withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("long"), "turns": F.coalesce("turns", F.lit(0)).cast("int")})


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mix: df's columns as they are, once for each turn of which at least half is served before the budget ends, sorted by virtual finish."""
    rows = written(df.withColumn(ROW, F.monotonically_increasing_id()), "mix-rows", "zstd")
    sizes = rows.select(ROW, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("order_key"))
    sizes = written(sizes, "mix-sizes")
    taken, _ = schedule(sizes, "source", **how)
    turns = taken.join(sizes.select(ROW, "size"), ROW).where("2 * words >= size").select(ROW, "epoch", "virtual_finish")
    # few columns go with the texts: the turns are what is joined, once, and then sorted
    return rows.join(turns.toDF(ROW, "_folioq_epoch", "_folioq_finish"), ROW).orderBy("_folioq_finish", ROW, "_folioq_epoch").select(*[F.col(f"`{c}`") for c in df.columns])


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(sized(docs, "text", ["doc_id"]).drop("text"), "mix-sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "turns", "virtual_finish")
